"""Benchmark decontamination: Wu-Manber search of whole texts for windows of benchmark words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._common import settle, spans, table

#: Words of a block. A block's shift is how far the search may move on where it ends at the block.
BLOCK = 2
#: (window, item) pairs that one set of tables holds; more are searched in passes of their own.
PAIRS_A_PART = 200_000
BYTES_AT_ONCE = 2_000_000
#: Every byte of UTF-8 as it stands in a word, or a blank: A-Z lower-cased; digits, a-z and all of the signs beyond ASCII kept.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


class Shifts:
    """The tables of windows of one length: shifts by block, and windows by their last block, then by their first."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], list[str]]]]] = defaultdict(lambda: defaultdict(list))

    def add(self, window: list[bytes], items: list[str]) -> None:
        for end in range(self.block, self.length + 1):
            key = b" ".join(window[end - self.block : end])
            self.shift[key] = min(self.shift.get(key, self.most), self.length - end)
        first = b" ".join(window[: self.block])
        self.buckets[key][first].append((window, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(end, items) of every occurrence. A block that no window holds moves the search on by all but a block."""
        length, block, most, shift = self.length, self.block, self.most, self.shift.get
        at, n = length, len(words)
        while at <= n:
            key = words[at - 1] if block == 1 else words[at - 2] + b" " + words[at - 1]
            step = shift(key, most)
            if step:
                at += step
                continue
            near = self.buckets[key].get(b" ".join(words[at - length : at - length + block]))
            for window, items in near or ():
                if words[at - length : at] == window:
                    yield at, items
            at += 1


class Search:
    """Windows of all lengths: the full ones, and the whole texts of items that are shorter."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]) -> None:
        self.sets: dict[int, Shifts] = {}
        for text, items in windows:
            words = text.split(b" ")
            self.sets.setdefault(len(words), Shifts(len(words))).add(words, items)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Disjoint stretches (start, end) of hit words, and the items found."""
        found, items = [], set()
        for length, one in self.sets.items():
            for end, names in one.search(words):
                found.append((end - length, end))
                items.update(names)
        merged: list[tuple[int, int]] = []
        for start, end in sorted(found):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged, sorted(items)


def windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(window, item): the distinct windows of ``length`` words of every item, or all its words where it has fewer."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, raw in zip(pdf["item"], pdf["raw"], strict=True):
                words = words_of(raw)
                own = {b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()
                yield pd.DataFrame({"window": list(own), "item": item})

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInPandas(cut, "window binary, item string").distinct()


def _found(windows: list, keys: list[str], kinds: dict[str, str]):
    """What an Arrow task does with rows of ``keys`` and raw: the keys, n_words, spans, items."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(windows.value)
        for batch in batches:
            raw, kept = batch.column("raw"), batch.select(keys)
            for lo, hi in spans(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), BYTES_AT_ONCE):
                counts, stretches, names = [], [], []
                for i in range(lo, hi):
                    words = words_of(raw[i].as_py())
                    where, items = search.hits(words)
                    counts.append(len(words))
                    stretches.append([{"start": a, "end": b} for a, b in where])
                    names.append(items)
                made = [pa.array(counts, pa.int64()), pa.array(stretches, span), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(kept.slice(lo, hi - lo).columns + made, [*keys, "n_words", "spans", "items"])
            pa.default_memory_pool().release_unused()

    return run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n_words long, spans array<struct<start: bigint, end: bigint>>, items array<string>"])


def _covered(stretches: Column) -> Column:
    """How many places lie in at least one of the stretches."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(F.array_sort(stretches), none, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, pairs_a_part: int = PAIRS_A_PART) -> DataFrame:
    """Each row of ``docs`` without its text, plus n_words, n_hit, spans (stretches of hit words, by word number) and items
    (the ids of items with an occurring window, as strings, sorted).

    A window is ``length`` consecutive words of an item, or all words of an item that has fewer. A word is hit where it
    lies in an occurrence of a window. Words are runs of digits, letters a-z (A-Z lower-cased) and signs beyond ASCII.
    Null and empty texts have no words; texts are searched whole; repeated rows are judged alike and each kept; items
    that repeat an id are one item; items without an id or without words take no part; without items nothing is hit; no
    rows give none. Columns of a caller that are named like the new ones are replaced.

    The benchmark's windows are made by Spark and dealt to parts of at most about ``pairs_a_part`` (window, item) pairs,
    which bounds what is broadcast. One part is one scan of the documents. Where there are more, numbered rows are
    written once and each part searches them; a row's stretches and items are then put together.
    """
    docs = docs.drop("n_words", "n_hit", "spans", "items")
    pairs = settle(windows(benchmark, length))
    parts = max(1, -(-pairs.count() // pairs_a_part))
    part = F.pmod(F.xxhash64("window", "item"), F.lit(parts))

    def tables(number: int):
        rows = pairs.where(part == number).groupBy("window").agg(F.collect_list("item").alias("items")).collect()
        return docs.sparkSession.sparkContext.broadcast([(bytes(r.window), list(r["items"])) for r in rows])

    rest = [c for c in docs.columns if c != "text"]
    if parts == 1:
        run, schema = _found(tables(0), rest, dict(docs.dtypes))
        found = docs.select(*rest, F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)
    else:
        own = [f"c_{c}" for c in rest]
        rows = docs.toDF(*[f"c_{c}" for c in docs.columns]).withColumn("row", F.monotonically_increasing_id())
        rows = settle(rows.select("row", *own, F.col("c_text").cast("binary").alias("raw")))
        met = []
        for number in range(parts):
            run, schema = _found(tables(number), ["row"], {"row": "bigint"})
            met.append(rows.select("row", "raw").mapInArrow(run, schema))
        every = met[0]
        for more in met[1:]:
            every = every.unionByName(more)
        whole = every.groupBy("row").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        found = rows.drop("raw").join(whole, "row").select(*[F.col(a).alias(b) for a, b in zip(own, rest, strict=True)], "n_words", "spans", "items")
    return found.withColumn("n_hit", _covered(F.col("spans")))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bp AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM bp),
lens AS (SELECT DISTINCT m FROM win),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= m),
hit AS (SELECT doc_id, dg.m, i, item FROM (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM dp) dg JOIN win ON win.m = dg.m AND win.g = dg.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY ALL),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY ALL)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
