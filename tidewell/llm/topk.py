"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm._common import settle, table

LEAF = 128


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros, which leave inner products as they are."""
    lengths = vectors.map(len).to_numpy()
    out = np.zeros((len(vectors), int(lengths.max(initial=0))), np.int64)
    if len(vectors) and (lengths == out.shape[1]).all():
        return np.stack(vectors.to_list()).astype(np.int64).reshape(out.shape)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def number_kind(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where it holds every inner product of a row of ``a`` with one of ``b``, else 64 bits of mantissa."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float64 if most < 2**52 else np.longdouble


class BallTree:
    """Nodes in arrays: each holds a run of ``order``, a centre, a radius and its children (-1: leaf)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        self.runs: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        centres, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = points[self.order[lo:hi]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            node = len(self.runs)
            self.runs.append((lo, hi))
            self.children.append((-1, -1))
            centres.append(centre)
            radii.append(away.max())
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = (pair[0], pair[1])
            if hi - lo > leaf and radii[-1] > 0:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                mid = lo + (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (other - far), mid - lo)]
                todo += [(lo, mid, node, 0), (mid, hi, node, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)


def search_block(
    queries: np.ndarray, query_rows: np.ndarray, points: np.ndarray, ids: np.ndarray, rows_: np.ndarray, kth: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, k per query, best first (-inf: none). ``kth``: a score that each query's k-th best reaches. A
    query meets no point of its own row number.

    Nodes are taken by their upper bound q.c + |q| r, largest first; a node stays open only for the queries whose
    current k-th score its bound reaches, and every leaf raises that score for the nodes still waiting.
    """
    kth = kth.copy()
    top = np.full((len(queries), k), -np.inf, queries.dtype)
    top_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    if not len(points):
        return top, top_ids
    tree, norms = BallTree(points), np.sqrt((queries**2).sum(axis=1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        reach = norms[rows] * (tree.radii[node] + 1e-9 * np.sqrt((tree.centres[node] ** 2).sum()))
        return queries[rows] @ tree.centres[node] + reach * (1 + 1e-9) + 1e-6  # rounding never closes a node that a tie could need

    rows = np.arange(len(queries))
    heap = [(0.0, 0, rows, bound(0, rows))]
    while heap:
        _, node, rows, bounds = heapq.heappop(heap)
        open_ = bounds >= kth[rows]
        rows = rows[open_]
        if not len(rows):
            continue
        if tree.children[node][0] >= 0:
            for child in tree.children[node]:
                b = bound(child, rows)
                near = b >= kth[rows]
                if near.any():
                    heapq.heappush(heap, (-b[near].max(), child, rows[near], b[near]))
            continue
        own = tree.order[slice(*tree.runs[node])]
        scores = queries[rows] @ points[own].T
        scores[(scores < kth[rows][:, None]) | (query_rows[rows][:, None] == rows_[own][None, :])] = -np.inf
        hit = np.isfinite(scores).any(axis=1)
        if not hit.any():
            continue
        rows, scores = rows[hit], scores[hit]
        all_scores = np.hstack([top[rows], scores])
        all_ids = np.hstack([top_ids[rows], np.broadcast_to(ids[own], scores.shape)])
        best = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
        top[rows] = np.take_along_axis(all_scores, best, axis=1)
        top_ids[rows] = np.take_along_axis(all_ids, best, axis=1)
        kth[rows] = np.maximum(kth[rows], top[rows, -1])
    return top, top_ids


#: No score is known yet.
LEAST = -(2**63)


def _answer(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = pdf[pdf["is_query"]].reset_index(drop=True), pdf[~pdf["is_query"]].reset_index(drop=True)
        schema = {"query_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64"}
        if q.empty or p.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in schema.items()})
        a, b = matrix(q["v"]), matrix(p["v"])
        wide = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))
        kind = number_kind(a, b)
        kth = np.where(q["kth"] == LEAST, -np.inf, q["kth"].to_numpy().astype(kind))
        top, ids = search_block(a.astype(kind), q["row"].to_numpy(), b.astype(kind), p["id"].to_numpy(), p["row"].to_numpy(), kth, k)
        row, col = np.nonzero(np.isfinite(top))
        score = np.clip(top[row, col], -(2.0**63), np.nextafter(kind(2.0**63), kind(0)))
        return pd.DataFrame({"query_row": q["row"].to_numpy()[row], "query_id": q["id"].to_numpy()[row], "vec_id": ids[row, col], "score": score.astype("int64")})

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 8192, block_queries: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all rows but its own.

    ``vectors``: id long, v array of whole numbers. Ties go to the smaller id. Rows that share an id are rows of their
    own: each is a candidate of the others, and each query row has ranks of its own. Null ids take no part; no rows give
    no rows; arrays of other columns are not looked at. Scores are exact while no sum passes 2^63; beyond, they are
    rounded and end at the ends of a long.

    Rows are dealt to shards by a hash of id and row number, so that equal vectors and ids spread. Every shard first
    answers its own queries, then queries visit the other shards in two waves, an eighth of them first. Before each
    wave a query takes along the k-th score that all shards so far have given it, which closes nodes from the start.
    Queries meet other shards in blocks of a fixed size, so no task holds more than one block and one shard; a shard's
    tree is made anew for each block, a small part of the search.
    """
    fields = "query_row long, query_id long, vec_id long, score long"
    rows = settle(vectors.where("id is not null").select("id", "v", is_query.alias("is_query"), F.monotonically_increasing_id().alias("row")))
    count = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    shards, blocks = max(1, math.ceil(count.n / shard_rows)), max(1, math.ceil(count.q / block_queries))
    # block numbers come from other bits than shard numbers, or a block would hold the queries of few shards
    rows = rows.withColumns({
        "shard": F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int"),
        "block": F.pmod(F.xxhash64("id", "row", F.lit("block")), F.lit(blocks)).cast("int"),
        "kth": F.lit(LEAST).cast("long"),
    })
    points, queries = rows.withColumn("is_query", F.lit(False)), rows.where("is_query")
    columns = ["shard", "block", "is_query", "id", "row", "v", "kth"]
    found = settle(
        points.select(columns).unionByName(queries.select(columns)).groupBy("shard").applyInPandas(_answer(k), fields)
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    spread = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(columns)
    cut = (shards - 1 + 7) // 8
    for low, high in ((1, cut), (cut + 1, shards - 1)):  # how many shards on from its own a query goes in the wave
        if low > high:
            continue
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        kth = ranked.select(F.col("query_row").alias("row"), F.col("score").alias("least"))
        seeded = queries.join(kth, "row", "left").withColumn("kth", F.coalesce("least", F.lit(LEAST)))
        going = seeded.withColumn("step", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("shard", F.pmod(F.col("shard") + F.col("step"), F.lit(shards))).select(columns)
        answers = spread.unionByName(going).groupBy("shard", "block").applyInPandas(_answer(k), fields)
        found = settle(found.unionByName(answers).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 64, *more: Column) -> DataFrame:
    """(id, v, more) with v = floor(scale * component); vectors that are null or hold null, NaN or infinity are left out."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"),
        *more,
    )


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
