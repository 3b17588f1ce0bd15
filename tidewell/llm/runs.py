"""Periodic runs of words: suffix classes united by decreasing common prefix, and texts with their repeats collapsed."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm._common import spans, table

BYTES_AT_ONCE = 1_000_000

#: (start, length, period), by word number.
Run = tuple[int, int, int]


def suffix_order(symbols: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """The places whose first ``least`` symbols occur again in their text, sorted as suffixes inside their class.

    ``symbols``: whole numbers, different between texts; ``end``: where each place's text ends. Classes of equal
    prefixes are split by the ranks twice as far on (prefix doubling); a place whose class holds no other is done.
    ``least`` is a power of two.
    """
    n = len(symbols)
    values, inverse, sizes = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[inverse]  # a class's rank is its first place in the sorted order
    active, width, kept, group = np.flatnonzero(sizes[inverse] > 1), 1, None, None
    while True:
        if width == least:
            kept, group = active, rank[active].copy()
        if not len(active):
            break
        onward = active + width
        second = np.where(onward < end[active], rank[np.minimum(onward, n - 1)], -1)
        first = rank[active]
        order = np.argsort(first * (n + 1) + second + 1, kind="stable")
        a, f, s = active[order], first[order], second[order]
        new_class = np.concatenate([[True], f[1:] != f[:-1]])
        new_part = new_class | np.concatenate([[True], s[1:] != s[:-1]])
        place = np.arange(len(a))
        class_at, part_at = np.maximum.accumulate(np.where(new_class, place, 0)), np.flatnonzero(new_part)
        rank[a] = f + np.repeat(part_at, np.diff(np.append(part_at, len(a)))) - class_at
        part_size = np.diff(np.append(part_at, len(a)))
        active = np.sort(a[np.repeat(part_size > 1, part_size)])
        width *= 2
        if kept is None and width > least:
            raise ValueError("least is no power of two")
    if kept is None or not len(kept):
        return np.zeros((2, 0), np.int64)
    order = np.argsort(rank[kept], kind="stable")
    return np.stack([kept[order], group[order]])


def neighbours(symbols: np.ndarray, end: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common prefix, place, next place in suffix order) of neighbours that share at least ``least`` symbols.

    Common prefixes are counted from left to right: the next place's is at most one shorter.
    """
    order, group = suffix_order(symbols, end, least)
    together = group[1:] == group[:-1]
    before = dict(zip(order[1:][together].tolist(), order[:-1][together].tolist(), strict=True))
    out, text, ends = [], symbols.tolist(), end.tolist()
    last, common = -2, 0
    for i in sorted(before):
        j = before[i]
        common = max(common - 1, least) if i == last + 1 else least
        stop = ends[i] - max(i, j)
        while common < stop and text[i + common] == text[j + common]:
            common += 1
        out.append((common, j, i))
        last = i
    return out


def runs_of(symbols: np.ndarray, end: np.ndarray, times: int, shortest: int) -> list[Run]:
    """Every maximal run with a smallest period q and a length of at least max(shortest, times x q), by place.

    Neighbours in suffix order are edges; they are taken by decreasing common prefix, and a union-find keeps each
    class's places in order (small classes go into large ones). When classes meet at prefix l, places i < j that become
    adjacent share exactly l symbols; d = j - i <= l says that period d holds from i to j + l. A smaller period would have
    brought a place between them before. A run's start and the place one period on become adjacent exactly once, so
    only pairs that can't be extended to the left are kept.
    """
    least = 1
    while 2 * least * times <= (times - 1) * shortest:  # a run shares length - period >= length (times - 1) / times symbols
        least *= 2
    edges = neighbours(symbols, end, least)
    edges.sort(key=lambda e: -e[0])
    text, ends = symbols.tolist(), end.tolist()
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    found: list[Run] = []

    def root(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = i = parent.setdefault(p, p)
        return i

    def seed(i: int, j: int, common: int) -> None:
        period, length = j - i, j - i + common
        if length >= shortest and length >= times * period:
            first = i == 0 or ends[i - 1] != ends[i] or text[i - 1] != text[j - 1]
            if first:
                found.append((i, length, period))

    for common, i, j in edges:
        a, b = root(i), root(j)
        if a == b:
            continue
        large, small = places.pop(a, None) or [a], places.pop(b, None) or [b]
        if len(large) < len(small):
            large, small, a, b = small, large, b, a
        last = -1
        for k, x in enumerate(small):  # pairs between two of the small class were adjacent before
            at = bisect_left(large, x)
            if at and (k == 0 or small[k - 1] < large[at - 1]):
                seed(large[at - 1], x, common)
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                seed(x, large[at], common)
        if len(small) * 64 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        parent[b] = a
        places[a] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def greatest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, exactly; ties go to the smaller start, then the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def text_runs(texts: list[list], times: int = 4, shortest: int = 6) -> list[list[Run]]:
    """The runs of each list of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in runs_of(own * (len(number) + 1) + ids, (starts + sizes)[own], times, shortest):
        out[own[start]].append((int(start - starts[own[start]]), length, period))
    return out


def periodic_runs(docs: DataFrame, row: Callable, fields: list[tuple[str, pa.DataType, str]], prepare: Callable | None = None, times: int = 4, shortest: int = 6) -> DataFrame:
    """Each row of ``docs`` without its text, plus what ``row(words, runs)`` makes of its words (UTF-8) and runs.

    Words are runs of signs other than the blank and the controls 09 to 0D; a run is a maximal stretch of words with
    smallest period q and at least max(``shortest``, ``times`` x q) words. ``prepare(doc_id, words)`` may change the
    words first. Null and empty texts have no words and no runs; texts are read whole, however long; repeated rows
    are judged alike and each kept; no rows give none. Columns of a caller that are named like the new ones are replaced.
    """
    docs = docs.drop(*[n for n, _, _ in fields])
    kinds = dict(docs.dtypes)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, kept = batch.column("text"), batch.select(rest)
            ids = batch.column("doc_id").to_pylist() if prepare else []
            for lo, hi in spans(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), BYTES_AT_ONCE):
                texts = [(raw[i].as_py() or "").encode().split() for i in range(lo, hi)]
                if prepare:
                    texts = [prepare(d, t) for d, t in zip(ids[lo:hi], texts, strict=True)]
                made = [row(t, r) for t, r in zip(texts, text_runs(texts, times, shortest), strict=True)]
                columns = [pa.array(c, t) for c, (_, t, _) in zip(zip(*made, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(kept.slice(lo, hi - lo).columns + columns, [*rest, *[n for n, _, _ in fields]])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], *[f"{n} {k}" for n, _, k in fields]]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame) -> DataFrame:
    """Each row with its runs (start, length, period) and, as text, its words without the runs' repeats, joined by one blank."""
    fields = [("runs", pa.list_(RUN), "array<struct<start: bigint, length: bigint, period: bigint>>"), ("text_without_repeats", pa.string(), "string")]
    row = lambda words, runs: ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(collapsed(words, runs)).decode())
    return periodic_runs(docs, row, fields).withColumnRenamed("text_without_repeats", "text")


def planted(doc_id: int | None, words: list) -> list:
    """The words of a tenth of the documents, by a hash of the id, with a tail that repeats its beginning."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // len(tail))))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(words: list, runs: list[Run]) -> tuple:
        best = greatest(runs)
        one = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (len(runs), *one, sha(listed.encode()), sha(b" ".join(collapsed(words, runs))))

    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [(n, pa.int64(), "long") for n in names] + [(n, pa.string(), "string") for n in ("runs_sha256", "collapsed_sha256")]
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), row, fields, planted)
