"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equally many words."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm._common import settle, table

#: Words: runs of signs other than the blank and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Slots of the schedule whose ranks are counted together.
RUN = 1 << 12
#: Cells of the unit interval, in which a point looks for its source's stretch.
CELLS = 1 << 10
#: Words of the schedule that are written together, in its order.
WORDS_A_PART = 4_000_000
GOLDEN = (math.sqrt(5) - 1) / 2


def row_hash(seed: int = 7):
    """Where a row stands among those of its source: a hash of all that the mix looks at."""
    return F.xxhash64("doc_id", "source", "text", F.lit(seed))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row: the number of words, 0 for a null text, and the row's hash."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash().alias("h"))


def targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, number, source_size, target) of every source: ``share`` of all words, dealt by weight.

    Sources in code point order, null last, weigh ``weights`` in turn. A source's target stops at ``most`` times its
    size and the rest goes to the others by weight, again and again. That ends at min(cap, weight x level) with one
    level for all, found here from running sums in the order in which caps are met: at level cap / weight. The
    sums run over one row a source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(1))
    ranked = total.withColumn("number", F.row_number().over(one.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"w": weight, "cap": most * F.col("source_size")}).withColumn("meets", F.col("cap") / F.col("w"))
    up = one.orderBy("meets", "number").rowsBetween(Window.unboundedPreceding, -1)
    on = one.orderBy("meets", "number").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    leveled = ranked.withColumn("level", left / F.sum("w").over(on))  # if the sources before this one are at their caps
    # the first source that doesn't meet its cap sets the level; where none is free, every source is at its cap
    level = F.min_by("level", F.when(F.col("level") <= F.col("meets"), F.struct("meets", "number"))).over(one)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * level))
    return leveled.select("source", "number", "source_size", target.alias("target"))


def blocks(sized: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """Pieces of shuffled documents in blocks: (number, block, low, high, row, doc_id, h, size).

    A source's documents, in hash order, lie end to end and are cut every ``block`` words. Rows are sorted by ranges of
    (source, hash, row number), so a source, an id or a row repeated many times is cut over tasks; running sums go over
    the partitions first and then inside each. Which of two equal rows comes first makes no difference to the result.
    Documents without words have a single piece without block.
    """
    order = ["number", "h", "row"]
    keyed = sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.source))
    keyed = keyed.select("number", "doc_id", "size", "h", F.monotonically_increasing_id().alias("row"))
    laid = settle(keyed.repartitionByRange(*order)).withColumn("part", F.spark_partition_id())
    sums = laid.groupBy("number", "part").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    upto = Window.partitionBy("number", "part").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lying = laid.join(sums, ["number", "part"]).withColumn("start", F.col("first") + F.sum("size").over(upto) - F.col("size"))
    end = F.col("start") + F.col("size")
    cut = lying.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))))
    low = F.greatest("start", F.col("block") * block) - F.col("block") * block
    high = F.least(end, (F.col("block") + 1) * block) - F.col("block") * block
    return cut.select("number", "block", low.alias("low"), high.alias("high"), "row", "doc_id", "h", "size")


def needs(plan: DataFrame, block: int) -> DataFrame:
    """The sources of ``plan`` that are to give words, with n_blocks, goal (whole words) and need: how many blocks, full or
    short, make the goal."""
    goal = F.floor("target")
    some = plan.where("target >= 1").withColumns({"n_blocks": F.ceil(F.col("source_size") / block).cast("long"), "goal": goal})
    need = F.col("n_blocks") * F.floor(F.col("goal") / F.col("source_size")) + F.ceil(F.col("goal") % F.col("source_size") / block)
    return some.select("number", "n_blocks", "source_size", "goal", need.cast("long").alias("need"))


def schedule(plan: DataFrame, slots: int, block: int) -> DataFrame:
    """(slot, number, block, turn, words): which block of which source stands where, in golden-ratio order.

    Slot i takes the source into whose stretch of the cumulative weights the fractional part of i x 0.618... falls. A
    source weighs as many slots as it needs, so a small source, whose last or only block is short, has enough of them,
    and every run of slots holds each source nearly in proportion. A source's r-th slot takes its block r, starting
    anew (``turn``) at its end. ``words``: how many words of the block it takes, all but where the target ends; a
    source that has met its target lets its further slots pass. Ranks are counted in runs of slots first. The few that
    a source still lacks after ``slots`` slots follow at the end, so every source reaches the floor of its target.
    """
    one = Window.partitionBy(F.lit(1))
    sources = needs(plan, block)
    ends = sources.withColumn("hi", F.sum("need").over(one.orderBy("number")) / F.sum("need").over(one))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(one.orderBy("number")), F.lit(0.0)))
    hi = F.when(F.row_number().over(one.orderBy(F.desc("number"))) == 1, F.lit(2.0)).otherwise(F.col("hi"))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(1.0)) * CELLS))
    ends = ends.select("number", "n_blocks", "source_size", "goal", "lo", hi.alias("hi")).withColumn("cell", F.explode(cells))
    points = plan.sparkSession.range(slots).withColumnRenamed("id", "slot")
    u = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    points = points.withColumns({"u": u, "cell": F.floor(u * CELLS), "run": F.floor(F.col("slot") / RUN)})
    placed = points.join(F.broadcast(ends), "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    counts = settle(placed.groupBy("number", "run").agg(F.count("*").alias("n")))
    had = counts.groupBy("number").agg(F.sum("n").alias("had"))
    ahead = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("number", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = placed.join(counts, ["number", "run"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("number", "run").orderBy("slot")) - 1
    )
    lacking = sources.join(had, "number", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("need > had")
    before = F.sum(F.col("need") - F.col("had")).over(one.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    late = lacking.withColumn("first", slots + F.coalesce(before, F.lit(0))).withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("need") - 1)))
    columns = ["number", "n_blocks", "source_size", "goal", "slot", "rank"]
    ranked = ranked.select(columns).unionByName(late.withColumn("slot", F.col("first") + F.col("rank") - F.col("had")).select(columns))
    turn, place = F.floor(F.col("rank") / F.col("n_blocks")), F.col("rank") % F.col("n_blocks")
    left = F.col("goal") - turn * F.col("source_size") - place * block
    return ranked.select("slot", "number", place.alias("block"), turn.alias("turn"), F.least(left, F.lit(block)).alias("words")).where("words > 0")


def placed_pieces(docs: DataFrame, block: int, weights: Sequence[float], share: float, most: float, most_sources: int) -> tuple[DataFrame, DataFrame]:
    """(pieces, plan): every piece of every row with each slot that takes words from it (slot, turn, hit), and the sources.

    Sources are a dimension: their table is broadcast, and more than ``most_sources`` are refused.
    """
    sized = settle(sizes(docs))
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    if sized.agg(F.count_distinct(named)).first()[0] > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    plan = settle(targets(sized, weights, share, most))
    slots = schedule(plan, needs(plan, block).agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0], block)
    hit = F.greatest(F.lit(0), F.least("high", "words") - F.col("low"))
    return blocks(sized, plan, block).join(slots, ["number", "block"], "left").withColumn("hit", F.when(F.col("words").isNotNull(), hit)), plan


def mix(docs: DataFrame, block: int = 256, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, most_sources: int = 10_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of every row: how many of its words the mix takes, repeats
    counted, and the slot of the schedule that first takes some (null: none does).

    Words are taken where the schedule takes a block in which they lie. Equal rows are rows of their own; null ids and
    null sources are values like any other; a very long text lies in many blocks; rows without words take nothing; no
    rows give none. Other columns than doc_id, source and text are not looked at. The same rows give the same mix.
    """
    pieces, plan = placed_pieces(docs, block, weights, share, most, most_sources)
    taken = pieces.groupBy("row").agg(
        F.first("number").alias("number"), F.first("doc_id").alias("doc_id"), F.first("size").alias("size"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("taken"), F.min(F.when(F.col("hit") > 0, F.col("slot"))).alias("first_slot"),
    )
    named = F.broadcast(plan.select("number", "source_size", "target"))
    return taken.join(named, "number").select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, block: int = 256) -> DataFrame:
    """Each document as often as the mix takes it - not at all, once or twice - in the order of the schedule's slots.

    A document's copy stands in a turn of its source; it is kept where the turn takes at least half of the document's
    words, and stands where the schedule first takes some of them. A source's taken blocks lie side by side, so only
    the documents at their edges are rounded to whole ones. Rows that agree in doc_id, source and text are judged
    together, by what is taken of them all. Documents without words go; no rows give none; a caller's columns keep
    their names and values, whatever they are called.
    """
    pieces, _ = placed_pieces(docs.select("doc_id", "source", "text"), block, (3, 1, 2), 1.5, 2.0, 10_000)
    rows = settle(pieces.groupBy("doc_id", "h", "row", "turn").agg(F.first("size").alias("size"), F.sum("hit").alias("hit"), F.min(F.when(F.col("hit") > 0, F.col("slot"))).alias("slot")))
    turns = rows.where("hit > 0").groupBy("doc_id", "h", "turn").agg(F.sum("hit").alias("hit"), F.min("slot").alias("slot"))
    alike = rows.groupBy("doc_id", "h", "row").agg(F.first("size").alias("size")).groupBy("doc_id", "h").agg(F.sum("size").alias("all"))
    both = turns.join(alike.withColumnRenamed("doc_id", "same"), [turns.h == alike.h, F.col("doc_id").eqNullSafe(F.col("same"))])
    chosen = settle(both.where(2 * F.col("hit") >= F.col("all")).select(F.col("doc_id").alias("id"), turns.h.alias("h"), "slot"))
    own = docs.toDF(*[f"d_{c}" for c in docs.columns])
    own = own.withColumn("hash", F.xxhash64("d_doc_id", "d_source", "d_text", F.lit(7)))
    again = own.join(chosen, (own["hash"] == chosen.h) & own.d_doc_id.eqNullSafe(chosen.id))
    # parts of equally many slots, small enough to be sorted in little memory
    last = chosen.agg(F.max("slot").alias("slot")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((last.slot or 0) * block / WORDS_A_PART))
    place = F.least(F.lit(parts - 1), F.floor(F.col("slot") / ((last.slot or 0) + 1) * parts)).cast("int")
    ordered = again.repartitionById(parts, place).sortWithinPartitions("slot")
    return ordered.select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])
