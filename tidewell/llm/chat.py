"""Chat formatting: conversations rebuilt from event logs, rendered to one text with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm._common import table

#: The template of a turn: OPEN role HEAD text CLOSE. An escaped role holds neither < nor >, an escaped text no <.
OPEN, HEAD, CLOSE = "<turn ", ">\n", "\n</turn>\n"
#: Signs of a streamed delta.
DELTA = 2048


def escape(text: Column) -> Column:
    r"""Backslashes become \s and < becomes \l, so a text holds no < and every backslash starts an escape."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    r"""As a text, and > becomes \g: the first > after a turn's opening is that of HEAD, whatever the role."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """The reverse of both; a text holds no \\g of its own, as each of its backslashes is followed by s or l."""
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of an event log.

    ``events``: conv_id, seq long, message long, kind, role, text. A message's events by sequence: ``start`` opens it
    and names its role, ``delta`` appends text, ``edit`` replaces all text so far, ``regenerate`` drops it, so that
    later deltas start anew, and ``retract`` withdraws the message unless an edit or regeneration follows. A null
    text is empty; the last role named holds; events of equal seq apply in the order of kind, then text. Messages
    come in the order of their numbers.

    What came before a message's last reset is dropped before texts meet, and events are dealt by conversation and
    message, so a long conversation is folded in many tasks.
    """
    message = Window.partitionBy("conv_id", "message")
    resets = F.max(F.when(F.col("kind").isin("edit", "regenerate", "retract"), F.struct("seq", "kind", "text"))).over(message)
    at = F.struct("seq", "kind", "text")
    kept = events.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({
        "reset": resets, "role": F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind"))).over(message),
    }).where(F.col("reset").isNull() | (at >= F.col("reset")))
    said = F.array_sort(F.collect_list(F.when(F.col("kind").isin("start", "delta", "edit"), at)))
    return (
        kept.groupBy("conv_id", "message")
        .agg(F.max("role").alias("role"), F.max("reset.kind").alias("last_reset"), F.count_if(F.col("kind") == "delta").alias("deltas"), said.alias("said"))
        .where(F.coalesce(F.col("last_reset") != "retract", F.lit(True)) | (F.col("deltas") > 0))
        .select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.concat_ws("", F.col("said.text")).alias("text"))
    )


def render(messages: DataFrame, masked: str = "assistant") -> DataFrame:
    """(conv_id, formatted, turns, loss): one text a conversation and which parts of it count for the loss.

    ``turns``: start and length of every turn in ``formatted``, in code points from 0. ``loss``: per turn, start and
    length of its escaped text where its role is ``masked``, else length 0.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(HEAD))
    shown = messages.select("conv_id", "message", F.concat(head, text, F.lit(CLOSE)).alias("piece"), F.length(head).cast("long").alias("lead"), F.when(F.col("role") == masked, F.length(text)).otherwise(0).cast("long").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct(
        "message", "piece", F.struct("start", F.length("piece").cast("long").alias("length")).alias("turn"),
        F.struct((F.col("start") + F.col("lead")).alias("start"), F.col("n").alias("length")).alias("loss"),
    )))
    return placed.groupBy("conv_id").agg(ordered.alias("all")).select(
        "conv_id", F.concat_ws("", F.col("all.piece")).alias("formatted"), F.col("all.turn").alias("turns"), F.col("all.loss").alias("loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, said, learnt): roles and texts recovered from the formatted text, and what the mask covers.

    The text is split at the close of turns, which no escaped text can hold; masked parts are cut out of their own
    turn, by the mask's offsets.
    """
    pieces = F.slice(F.split("formatted", F.lit("(?<=\n</turn>\n)")), F.lit(1), F.size("turns"))
    inside = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p) - len(OPEN) - len(CLOSE))
    said = F.transform("pieces", lambda p: F.struct(
        unescape(F.substring_index(inside(p), HEAD, 1)).alias("role"),
        unescape(F.substring(inside(p), F.length(F.substring_index(inside(p), HEAD, 1)) + len(HEAD) + 1, F.length(p))).alias("text"),
    ))
    learnt = F.transform(
        F.filter(F.arrays_zip("pieces", "turns", "loss"), lambda z: z["loss"]["length"] > 0),
        lambda z: unescape(F.substring(z["pieces"], (z["loss"]["start"] - z["turns"]["start"] + 1).cast("int"), z["loss"]["length"].cast("int"))),
    )
    return formatted.withColumn("pieces", pieces).select("conv_id", "formatted", said.alias("said"), learnt.alias("learnt"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A log of (conv_id, turn, role, text) rows as a chat server streams it: a start and deltas for every row.

    Rows with the same turn follow one another by role, then text, nulls first; none is dropped. A conversation becomes
    one text, so its rows meet in one row in the end; what is cut over tasks before that is the fold of its messages.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    parts = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)))
    return rows.select("conv_id", "message", "role", F.posexplode(parts)).select(
        "conv_id", F.col("pos").cast("long").alias("seq"), "message", F.when(F.col("pos") == 0, "start").otherwise("delta").alias("kind"), "role", F.col("col").alias("text")
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    return render(fold(as_events(conversations)))


#: A conversation that holds the template's own control strings and an escape sign: fixed value of the query.
TRICKY = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    made = rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    back = read_back(format_conversations(rows.unionByName(made)))
    turns = F.concat_ws("", F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.col("learnt"))
    return back.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 17 + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\s'), '<', '\l')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
