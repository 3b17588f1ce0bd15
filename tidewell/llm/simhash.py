"""SimHash near-duplicates: fingerprints, and their links within a Hamming distance, by a grid on segment popcounts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._common import settle, spans, table
from tidewell.llm.components import connected_components, with_least

WORDS_AT_ONCE = 250_000
#: Two-bit segments: the popcounts of all 32 lie side by side in one 64-bit number, two bits each.
LOW_BITS = 0x5555555555555555
#: Rows of one grid cell that a task compares among themselves; a larger cell is cut into chunks of so many.
CHUNK = 4096


def _fold(hashes: list[int], counts: np.ndarray) -> np.ndarray:
    """One fingerprint a text: the bits that are set in over half of its hashes."""
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    ends = starts + counts[some]
    majority = np.zeros((len(counts), 64), np.uint8)
    for i, lo, hi in zip(some.tolist(), starts.tolist(), ends.tolist(), strict=True):
        majority[i] = 2 * bits[lo:hi].sum(axis=0, dtype=np.int32) > hi - lo
    return np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(texts: list[str], shingle: int) -> np.ndarray:
    """64-bit fingerprints as signed numbers; zero for a text without words.

    Splitting the UTF-8 bytes splits at blanks and the controls 09 to 0D, and lower-casing them changes A to Z alone.
    """
    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    done = 0
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if words:
            joined = b" ".join(words)
            if len(words) <= shingle:
                hashes.append(digest(joined, 42))
                counts[i] = 1
            else:
                ends = list(itertools.accumulate([len(w) + 1 for w in words]))
                starts = [0, *ends[:-1]]
                hashes += [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
                counts[i] = len(words) - shingle + 1
        if len(hashes) >= WORDS_AT_ONCE:
            out.append(_fold(hashes, counts[done : i + 1]))
            hashes, done = [], i + 1
    out.append(_fold(hashes, counts[done:]))
    return np.concatenate(out)


def fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Each row of ``docs`` without its text, plus fp long. A null text has no words."""
    docs = docs.drop("fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, out = pdf["text"].fillna(""), np.zeros(len(pdf), np.int64)
            for lo, hi in spans(texts.str.len().to_numpy(), 4_000_000):
                out[lo:hi] = fingerprints(texts.iloc[lo:hi].to_list(), shingle)
            yield pdf.drop(columns="text").assign(fp=out)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInPandas(run, ", ".join(x for x in (kept, "fp long") if x))


def grid(bits: int) -> list[int]:
    """Masks of the grid's projections, as signed numbers.

    Two fingerprints that differ in ``bits`` bits have popcount vectors at a Manhattan distance of ``bits`` at most.
    With the 32 segments in bits + 3 groups, at most ``bits`` groups hold a difference, so some three groups hold
    none: the pair shares a cell (of width one) of the projection on those three groups.
    """
    groups = np.array_split(np.arange(32), bits + 3)
    masks = [sum(3 << (2 * int(s)) for g in three for s in g) for three in itertools.combinations(groups, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def segment_counts(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(LOW_BITS)
    x = fp.view(np.uint64)
    return (x & low) + ((x >> np.uint64(1)) & low)


def near(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs differ in at most ``bits`` bits: first the Manhattan distance of counts, then exactly.

    Counts lie in 0 to 2. Spread to four bits each they subtract without borrowing: |x - y| = max - min per field.
    """
    four = np.uint64(0x3333333333333333)
    total = np.zeros(len(a), np.int64)
    for shift in (np.uint64(0), np.uint64(2)):
        x, y = (ca >> shift) & four, (cb >> shift) & four
        gap = (x | np.uint64(0x8888888888888888)) - y  # 8 + (x - y) in each field
        odd = gap & np.uint64(0x1111111111111111)  # |x - y| = 1
        two = (gap >> np.uint64(1)) & ~gap & np.uint64(0x1111111111111111)  # 8 + 2 or 8 - 2: binary 1010 or 0110
        total += np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(two)
    ok = total <= bits
    ok[ok] = np.bitwise_count((a[ok] ^ b[ok]).view(np.uint64)) <= bits
    return ok


class Forest:
    """Union-find over positions; ``links`` keeps the pairs that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root, self.links = np.arange(n), []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        apart = self.root[left] != self.root[right]
        for i, j in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((i, j))
        if apart.any():
            while ((above := self.root[self.root]) != self.root).any():
                self.root = above


def _link_sorted(cell: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """Spanning links (pairs of positions) of every run of equal ``cell``; each row meets the rows of its run."""
    counts, forest = segment_counts(fp), Forest(len(fp))
    left = np.arange(len(fp) - 1)
    for step in range(1, len(fp)):
        left = left[left + step < len(fp)]
        left = left[cell[left] == cell[left + step]]
        if not len(left):
            break
        ok = near(fp[left], fp[left + step], counts[left], counts[left + step], bits)
        if ok.any():
            forest.add(left[ok], left[ok] + step)
    return np.array(forest.links, np.int64).reshape(-1, 2)


LINK_FIELDS = "x long, y long, mask int, cell long, chunk int"


def _cells(batches: Iterator[pd.DataFrame], bits: int, chunk: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (mask, cell). Whole small cells are linked here; a cell that outgrows ``chunk`` rows is
    passed on in numbered chunks (rows with a chunk number and fp in x), in bounded memory whatever its size."""
    none = pd.DataFrame({"mask": pd.Series(dtype="int32"), "cell": pd.Series(dtype="int64"), "fp": pd.Series(dtype="int64")})

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, cell, fp = (pdf[c].to_numpy() for c in ("mask", "cell", "fp"))
        run = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1])]))[: len(pdf)]
        alone = np.ones(len(pdf), bool)
        same = run[1:] == run[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        run, fp = run[~alone], fp[~alone]
        pairs = _link_sorted(run, fp, bits) if len(fp) > 1 else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"x": fp[pairs[:, 0]], "y": fp[pairs[:, 1]], "mask": 0, "cell": 0, "chunk": -1})

    def passed(pdf: pd.DataFrame, first: int) -> pd.DataFrame:
        return pd.DataFrame({"x": pdf["fp"], "y": 0, "mask": pdf["mask"], "cell": pdf["cell"], "chunk": first + np.arange(len(pdf)) // chunk})

    held, at, given = none, None, 0  # the last run so far, its key, and how many of its chunks were passed on
    for pdf in batches:
        pdf = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
        if pdf.empty:
            continue
        last = (pdf["mask"].iloc[-1], pdf["cell"].iloc[-1])
        in_last = ((pdf["mask"] == last[0]) & (pdf["cell"] == last[1])).to_numpy()
        done, held = pdf[~in_last], pdf[in_last]
        if given and at != last:
            rest = ((done["mask"] == at[0]) & (done["cell"] == at[1])).to_numpy()
            if rest.any():
                yield passed(done[rest], given)
                done = done[~rest]
            given = 0
        for small, big in _split_large(done, chunk):
            if len(small):
                yield linked(small)
            if len(big):
                yield passed(big, 0)
        at = last
        if len(held) > chunk or given:
            whole = len(held) // chunk * chunk
            if whole:
                yield passed(held.iloc[:whole], given)
                given += whole // chunk
                held = held.iloc[whole:]
    if len(held):
        yield passed(held, given) if given else linked(held)


def _split_large(pdf: pd.DataFrame, chunk: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    if pdf.empty:
        return
    size = pdf.groupby(["mask", "cell"], sort=False)["fp"].transform("size").to_numpy()
    yield pdf[size <= chunk], pdf.iloc[:0]
    for _, big in pdf[size > chunk].groupby(["mask", "cell"], sort=False):
        yield pdf.iloc[:0], big


def _chunk_pair(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, chunk = pdf["x"].to_numpy(), pdf["chunk"].to_numpy()
        counts, forest = segment_counts(fp), Forest(len(fp))
        lower = np.flatnonzero(chunk == chunk.min())
        upper = np.flatnonzero(chunk == chunk.max())
        for i in upper.tolist():
            others = lower[lower < i] if chunk.min() == chunk.max() else lower
            mine = np.full(len(others), i)
            ok = near(fp[others], fp[mine], counts[others], counts[mine], bits)
            forest.add(others[ok], mine[ok])
        pairs = np.array(forest.links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"x": fp[pairs[:, 0]], "y": fp[pairs[:, 1]]})

    return run


def hamming_links(prints: DataFrame, bits: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(x, y): links that connect the distinct fingerprints ``prints``.fp just as all pairs within ``bits`` bits do.

    Every fingerprint goes to one cell of each projection of the popcount grid; the rows of a cell are tested by
    Manhattan distance and then exactly. A cell returns a spanning forest of its links, so the result grows with
    the rows, not with the pairs of a group. Cells beyond ``chunk`` rows are cut, and pairs of chunks are compared
    in separate tasks: the work stays whole, no task holds more than two chunks.
    """
    masks = grid(bits)
    a, b = F.col("fp").bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(LOW_BITS))
    counts = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # a + b in every field, without a carry
    numbered = F.array(*[F.struct(F.lit(i).alias("mask"), counts.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    placed = prints.select("fp").repartition("fp").select("fp", F.explode(numbered).alias("at")).select(F.col("at.mask").alias("mask"), F.col("at.cell").alias("cell"), "fp")
    dealt = placed.repartition("mask", "cell").sortWithinPartitions("mask", "cell")
    first = settle(dealt.mapInPandas(lambda it: _cells(it, bits, chunk), LINK_FIELDS))
    links, large = first.where("chunk < 0").select("x", "y"), first.where("chunk >= 0").select("mask", "cell", "chunk", "x")
    last = large.groupBy("mask", "cell").agg(F.max("chunk").alias("last"))
    meet = (
        large.join(last, ["mask", "cell"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("mask", "cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "x")
    )
    return links.unionByName(meet.groupBy("mask", "cell", "i", "j").applyInPandas(_chunk_pair(bits), "x long, y long"))


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """Each row of ``docs`` without its text, plus fp, component_id, its group's smallest doc_id, and component.

    ``component`` is the group's smallest fingerprint: two groups may have the same smallest doc_id, where ids repeat.
    Rows with equal fingerprints are one node, so copies are never paired with each other. Repeated rows and rows
    that share a doc_id stay apart rows; a null doc_id is no group's smallest unless it has no other. Texts are read whole,
    however long; columns of a caller named fp, component_id or component are replaced. No rows give none.
    """
    rows = settle(fingerprint(docs.drop("component_id", "component"), shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(hamming_links(nodes.select("fp"), bits))
    member = settle(nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left"))
    return rows.join(with_least(member, "fp", "least").select("fp", "component_id", "component"), "fp")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, that with the smallest doc_id.

    Of the group's rows with this doc_id the one with the least digests stays; groups without a doc_id keep one row likewise.
    The choice is made on narrow rows, by minima that are combined before the shuffle; then texts move once, to meet
    the chosen digests: 128 bits of doc_id and text stand for a row, texts are not compared. Null and empty texts are
    one group, as all without words; no rows give none; a caller's columns keep their names and values, whatever they
    are called.
    """
    own = docs.toDF(*[f"d_{c}" for c in docs.columns])
    digests = {"k1": F.xxhash64("d_doc_id", "d_text"), "k2": F.xxhash64("d_text", F.lit("second"), "d_doc_id")}
    marked = own.withColumns(digests)
    found = near_duplicates(marked.select(F.col("d_doc_id").alias("doc_id"), F.col("d_text").alias("text"), "k1", "k2"))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = first.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2").distinct()
    kept = marked.join(chosen, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])
