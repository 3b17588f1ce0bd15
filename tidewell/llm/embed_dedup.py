"""Embedding near-duplicates: an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._common import sampled, settle, table
from tidewell.llm.components import connected_components, with_least
from tidewell.llm.simhash import Forest

#: Rows of a block of the sequence; two blocks at most meet in one task.
BLOCK = 2048
#: Rows of an interval that is compared row by row instead of being cut again.
LEAF = 256
#: Principal dimensions whose coordinates bound a distance from below; the length of the rest is one more.
LEADING = 16


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors over their largest component and then over their length, so that no square over- or underflows."""
    wide = int(vectors.map(len).max())
    out = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int, sample: int = 4096) -> np.ndarray:
    """Leading principal axes (rows) of at most ``sample`` unit vectors, the first by a hash of their values.

    They decide how well the grid prunes, never which pairs link.
    """
    got = sampled(vectors.select("embedding"), ["embedding"], sample).toPandas()
    if got.empty:
        return np.zeros((dims, 0))
    unit = unit_rows(got["embedding"])
    _, axes = np.linalg.eigh(np.cov(unit.T).reshape(unit.shape[1], unit.shape[1]) if len(unit) > 1 else np.zeros((unit.shape[1],) * 2))
    return axes.T[::-1][:dims]


def coordinates(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the principal axes and, last, the length of what they leave of each unit vector. Between these
    rows, distances are never longer than between the vectors."""
    wide = max(unit.shape[1], axes.shape[1])
    at = np.pad(unit, ((0, 0), (0, wide - unit.shape[1]))) @ np.pad(axes, ((0, 0), (0, wide - axes.shape[1]))).T
    rest = np.sqrt(np.maximum(0, 1 - (at**2).sum(axis=1, keepdims=True)))
    return np.hstack([at, rest])


def _place(batches: Iterator[pd.DataFrame], axes: np.ndarray, width: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            cells = np.floor(coordinates(unit_rows(pdf["embedding"]), axes)[:, :-1] / width).astype("int32")
            yield pdf[["label", "embedding", "least", "copies"]].assign(cells=list(cells))


def _boxes_apart(a: np.ndarray, b: np.ndarray, epsilon: float) -> bool:
    """Whether the bounding boxes of two intervals are provably further apart than epsilon."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float((gap**2).sum()) > (epsilon + 1e-9) ** 2


class Join:
    """Links between the rows of one label that are known to a task: counts of linked copies and a spanning forest.

    ``compared`` counts the pairs of rows that were compared in all their dimensions.
    """

    def __init__(self, unit: np.ndarray, at: np.ndarray, copies: np.ndarray, least: float) -> None:
        self.unit, self.at, self.copies, self.least, self.compared = unit, at, copies, least, 0
        self.epsilon = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
        self.linked, self.forest = np.zeros(len(unit), np.int64), Forest(len(unit))

    def intervals(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """Join two intervals of the sequence, or one with itself, cutting the longer one until both are short."""
        if a[0] >= a[1] or b[0] >= b[1] or _boxes_apart(self.at[slice(*a)], self.at[slice(*b)], self.epsilon):
            return
        if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
            self._rows(a, b)
        elif a == b:
            mid = (a[0] + a[1]) // 2
            lower, upper = (a[0], mid), (mid, a[1])
            self.intervals(lower, lower)
            self.intervals(lower, upper)
            self.intervals(upper, upper)
        else:
            long, short = (a, b) if a[1] - a[0] >= b[1] - b[0] else (b, a)
            mid = (long[0] + long[1]) // 2
            self.intervals((long[0], mid), short)
            self.intervals((mid, long[1]), short)

    def _rows(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """The inner product of the short rows bounds the cosine from above; only pairs that it leaves open are compared."""
        left, right = slice(*a), slice(*b)
        open_ = self.at[left] @ self.at[right].T >= self.least - 1e-9
        i, j = np.nonzero(np.triu(open_, 1) if a == b else open_)
        self.compared += len(i)
        if 8 * len(i) > open_.size:  # most pairs are open, as among near copies: one product for all of them
            cosine = (self.unit[left] @ self.unit[right].T)[i, j]
        else:
            cosine = np.einsum("ij,ij->i", self.unit[left][i], self.unit[right][j])
        near = cosine >= self.least
        i, j = i[near] + a[0], j[near] + b[0]
        for x, y in ((i, j), (j, i)):
            np.add.at(self.linked, x, self.copies[y])
        self.forest.add(i, j)


def _pair(least: float, axes: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        first, last = pdf["block"].min(), pdf["block"].max()
        for _, own in pdf.groupby("label"):
            own = own.sort_values(["block", "node"])
            unit = unit_rows(own["embedding"])
            join = Join(unit, coordinates(unit, axes), own["copies"].to_numpy(), least)
            whole, cut = (0, len(own)), int((own["block"] == first).sum())
            if first == last:
                join.intervals(whole, whole)
            else:
                join.intervals((0, cut), (cut, len(own)))
            node, hit = own["node"].to_numpy(), np.flatnonzero(join.linked)
            out.append(pd.DataFrame({"node": node[hit], "links": join.linked[hit], "other": node[join.forest.root[hit]]}))
        return pd.concat(out, ignore_index=True)

    return run


def epsilon_join(classes: DataFrame, least: float, dims: int = 4, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the distinct vectors with their numbers, and what each of them links with.

    ``classes``: label, embedding (without zeros, nulls, NaN), least, copies. Unit vectors at a cosine of ``least`` or
    more lie within epsilon = sqrt(2 - 2 least). They are sorted by label and by their cells, epsilon wide, on the
    leading principal axes, and cut into blocks. Blocks of a label meet in a task of their own unless their cells
    are two or more apart on some axis; in the task, intervals are halved and skipped by the same argument on exact
    coordinates on 16 axes and the length of the rest. Of the pairs of two short intervals only those are compared whose
    coordinates leave a cosine of ``least`` open. Blocks travel as the vectors they were given. A task gives each vector its number of linked copies and one link of a spanning forest, so what
    leaves it grows with its rows.
    """
    width = math.sqrt(max(1e-12, 2 - 2 * least)) + 1e-9
    axes = principal_axes(classes, max(dims, LEADING))
    # missing axes are zero: every vector is then in cell 0 of them
    first = np.zeros((dims, axes.shape[1]))
    first[: len(axes[:dims])] = axes[:dims]
    kind, label = (classes.schema[c].dataType.simpleString() for c in ("embedding", "label"))
    schema = f"label {label}, embedding {kind}, least long, copies long, cells array<int>"
    placed = classes.mapInPandas(lambda it: _place(it, first, width), schema)
    # the last key spreads vectors of one cell over partitions; ids are stable once they are written
    order = ["label", *(F.col("cells")[i] for i in range(dims)), F.xxhash64("embedding")]
    nodes = settle(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    # a number is its partition's, in the high bits, then the row's place in it
    nodes = nodes.withColumn("block", F.shiftright("node", 33) * (1 << 22) + F.floor(F.col("node").bitwiseAND(F.lit((1 << 33) - 1)) / block))
    low, high = ([f(F.col("cells")[i]).alias(f"{n}{i}") for i in range(dims)] for f, n in ((F.min, "lo"), (F.max, "hi")))
    boxes = settle(nodes.groupBy("label", "block").agg(*low, *high))
    reach = boxes.withColumn("cell", F.explode(F.sequence(F.col("lo0") - 1, F.col("hi0") + 1))).alias("a")
    other = boxes.withColumn("cell", F.explode(F.sequence("lo0", "hi0"))).alias("b")
    close = F.lit(True)
    for i in range(1, dims):
        close &= (F.col(f"a.lo{i}") <= F.col(f"b.hi{i}") + 1) & (F.col(f"b.lo{i}") <= F.col(f"a.hi{i}") + 1)
    meet = reach.join(other, ["label", "cell"]).where((F.col("a.block") <= F.col("b.block")) & close)
    pairs = meet.select(F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    both = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    rows = both.join(nodes.select("block", "node", "label", "copies", "embedding"), "block")
    found = settle(rows.groupBy("i", "j").applyInPandas(_pair(least, axes), "node long, links long, other long"))
    return nodes, found


def embedding_duplicates(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link where their labels, of any type that can be sorted, are equal and not null and their cosine reaches ``least``. Vectors that are null,
    empty or zero or hold null, NaN or infinity link with nothing and are their own component, as are rows without
    a label. Equal vectors of a label are one class: its copies are counted, never paired. Shorter vectors count as
    filled up with zeros. ``kept`` marks the rows whose vec_id is their component's smallest.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    kind = embeddings.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", "label", vector.alias("embedding"))
    rows = rows.withColumn("sound", F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    good, rest = rows.where("sound"), rows.where("not coalesce(sound, false)")
    classes = settle(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    nodes, found = epsilon_join(classes, least)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("node", "other"))
    member = settle(
        nodes.select("node", "label", "embedding", "least", "copies").join(parts, "node", "left").join(links, "node", "left")
        .select("node", "label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    )
    done = good.join(with_least(member, "node", "least"), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""
