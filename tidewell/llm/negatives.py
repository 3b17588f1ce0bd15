"""Hard-negative mining: anchors in clusters, each cluster with one list of candidates by an angular upper bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm._common import sampled, settle, table
from tidewell.llm.topk import matrix, number_kind, quantised

#: Candidates of a list that the members of a cluster meet at once.
STEP = 256
#: Anchors that the centres are fitted on, and how many clusters there are at most.
SAMPLE, CLUSTERS = 4096, 64


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector stays zero."""
    v = v.astype(np.float64)
    length = np.sqrt((v**2).sum(axis=1))
    return v / np.where(length > 0, length, 1)[:, None], length


def centres(unit: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """``k`` unit vectors around which the rows of ``unit`` gather, by spherical k-means; fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    c = unit[rng.permutation(len(unit))[:k]]
    for _ in range(rounds):
        near = (unit @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, unit)
        c = np.where((np.abs(sums).sum(axis=1) > 0)[:, None], directions(sums)[0], c)
    return c


class Lists:
    """The candidates of one shard, sorted for one cluster by how much a member's score can be at most.

    A member whose angle to the centre is at most ``widest`` has an angle of at least theta - widest to a candidate at
    theta, so its score is at most |member| x |candidate| x cos(max(0, theta - widest)): one order for all members.
    """

    def __init__(self, unit: np.ndarray, length: np.ndarray, centre: np.ndarray, widest: float) -> None:
        theta = np.arccos(np.clip(unit @ centre, -1, 1))
        reach = length * np.cos(np.maximum(0, theta - widest))
        self.order = np.argsort(-reach, kind="stable")
        self.reach = reach[self.order]
        self.slack = 1e-6 * (float(length.max(initial=0)) + 1)  # rounding never ends a walk that a tie could need

    def walk(self, members: np.ndarray, lengths: np.ndarray, among: np.ndarray | None, needed, take) -> int:
        """Walk the list (or the part ``among``, a mask over candidates) from the top, a step of candidates at a time.

        ``needed(members)``: a score below which a candidate is of no use to each; a member leaves once the bound of
        what is left falls below it. ``take(members, candidates)`` sees a step. Returns how many pairs were met.
        """
        order, reach = (self.order, self.reach) if among is None else (self.order[among[self.order]], self.reach[among[self.order]])
        at, met = 0, 0
        while at < len(order) and len(members):
            stay = lengths[members] * (reach[at] + self.slack) + 1e-6 >= needed(members)
            members = members[stay]
            if len(members):
                take(members, order[at : at + STEP])
                met += len(members) * len(order[at : at + STEP])
            at += STEP
        return met


def best_of(top: np.ndarray, top_rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of what is held and what is new, per line: higher scores first, ties to smaller ids (-inf: none)."""
    every = np.hstack([top, scores])
    every_row = np.hstack([top_rows, np.broadcast_to(rows, scores.shape)])
    best = np.lexsort((np.where(every_row >= 0, ids[every_row], np.iinfo(np.int64).max), -every), axis=-1)[:, :k]
    return np.take_along_axis(every, best, axis=1), np.take_along_axis(every_row, best, axis=1)


class Meeting:
    """One block of anchors and one shard of candidates."""

    def __init__(self, block: pd.Series, shard: pd.Series, centre: np.ndarray) -> None:
        q, p = _unpacked(block), _unpacked(shard)
        wide = max(q.shape[1], p.shape[1])
        q, p = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, p))
        kind = number_kind(8 * q, p)  # scores are compared at up to a few times their size
        self.q, self.p = q.astype(kind), p.astype(kind)
        self.q_rows, self.p_rows = (np.frombuffer(x["rows"], np.int64) for x in (block, shard))
        self.ids = np.frombuffer(shard["ids"], np.int64)
        codes = pd.factorize(np.concatenate([np.asarray(block["labels"]), np.asarray(shard["labels"])]))[0]
        self.q_label, self.p_label = codes[: len(q)], codes[len(q) :]
        q_unit, self.lengths = directions(q)
        p_unit, p_length = directions(p)
        c = np.pad(centre, ((0, 0), (0, max(0, wide - centre.shape[1]))))
        cosine = np.clip(q_unit @ c[:, :wide].T, -1, 1)
        cluster = cosine.argmax(axis=1)
        self.clusters = []
        for k in np.unique(cluster):
            members = np.flatnonzero(cluster == k)
            self.clusters.append((members, Lists(p_unit, p_length, c[k, :wide], float(np.arccos(cosine[members, k].min())))))

    def same_label(self, k: int, least: np.ndarray) -> pd.DataFrame:
        """Each anchor's ``k`` best other rows of its label. ``least``: scores that their k-th best reaches anyway."""
        top, rows, least = np.full((len(self.q), k), -np.inf, self.q.dtype), np.full((len(self.q), k), -1), least.copy()

        def take(members: np.ndarray, cand: np.ndarray) -> None:
            scores = self.q[members] @ self.p[cand].T
            scores[(scores < least[members][:, None]) | (self.q_rows[members][:, None] == self.p_rows[cand][None, :])] = -np.inf
            hit = np.isfinite(scores).any(axis=1)
            at = members[hit]
            top[at], rows[at] = best_of(top[at], rows[at], self.ids, scores[hit], cand, k)
            least[at] = np.maximum(least[at], top[at, -1])

        for members, lists in self.clusters:
            for label in np.unique(self.q_label[members]):
                lists.walk(members[self.q_label[members] == label], self.lengths, self.p_label == label, lambda m: least[m], take)
        return self._rows(np.nonzero(np.isfinite(top)), top, rows)

    def other_labels(self, k: int, positive: np.ndarray, least: np.ndarray, low: int, high: int) -> pd.DataFrame:
        """What any positive (columns of ``positive``: scores, NaN for none) needs: its ``k`` best rows of other labels with
        low x positive <= 100 x score <= high x positive. ``least``: scores that a positive's k-th best reaches anyway."""
        slots = positive.shape[1]
        low_score, high_score = low * positive, high * positive
        some = ~np.isnan(positive) & (low_score <= high_score)
        least = np.where(some, np.maximum(least, low_score / 100), np.inf)
        top = np.full((slots, len(self.q), k), -np.inf, self.q.dtype)
        rows = np.full(top.shape, -1)

        def take(members: np.ndarray, cand: np.ndarray) -> None:
            scores = self.q[members] @ self.p[cand].T
            scores[self.q_label[members][:, None] == self.p_label[cand][None, :]] = -np.inf
            for s in range(slots):
                fit = some[members, s][:, None] & (100 * scores >= low_score[members, s][:, None]) & (100 * scores <= high_score[members, s][:, None])
                fit &= scores >= least[members, s][:, None] - 1e-6
                hit = fit.any(axis=1)
                at = members[hit]
                if len(at):
                    top[s, at], rows[s, at] = best_of(top[s, at], rows[s, at], self.ids, np.where(fit[hit], scores[hit], -np.inf), cand, k)
                    least[at, s] = np.maximum(least[at, s], top[s, at, -1])

        for members, lists in self.clusters:
            lists.walk(members, self.lengths, None, lambda m: least[m].min(axis=1), take)
        s, anchor, col = np.nonzero(np.isfinite(top))
        once = pd.DataFrame({"anchor": anchor, "row": rows[s, anchor, col], "score": top[s, anchor, col]}).drop_duplicates(["anchor", "row"])
        return self._made(once["anchor"].to_numpy(), once["row"].to_numpy(), once["score"].to_numpy())

    def _rows(self, where: tuple[np.ndarray, np.ndarray], top: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        return self._made(where[0], rows[where], top[where])

    def _made(self, anchor: np.ndarray, row: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"anchor_row": self.q_rows[anchor], "row": self.p_rows[row], "id": self.ids[row], "score": score.astype("int64")})


FOUND = "anchor_row long, row long, id long, score long"


def _packed(keys: list[str]):
    """Rows of a key as one: their vectors in the smallest whole numbers that hold them, row numbers, ids, labels."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pdf["v"])
        kind = next((k for k in (np.int16, np.int32) if np.abs(v).max(initial=0) <= np.iinfo(k).max), np.int64)
        one = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([one | {
            "v": v.astype(kind).tobytes(), "kind": np.dtype(kind).name, "wide": v.shape[1], "rows": pdf["row"].to_numpy(np.int64).tobytes(),
            "ids": pdf["id"].to_numpy(np.int64).tobytes(), "labels": pdf["label"].to_list(),
        }])

    return run


def _unpacked(x: pd.Series) -> np.ndarray:
    n = len(x["rows"]) // 8
    return np.frombuffer(x["v"], x["kind"]).astype(np.int64).reshape(n, x["wide"])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, shard_rows: int = 8192, block_anchors: int = 2048
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being inner products.

    ``vectors``: id long, label of any type, v array of whole numbers. An anchor's positives are its first
    ``positives`` other rows of the same label; the negatives of an anchor and a positive are the first ``negatives``
    rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's. Higher scores come first, ties
    by smaller id; a positive with a negative score has none. Rows with a null id, label or vector take no part. Rows
    that share an id are rows of their own; shorter vectors count as filled up with zeros; no anchors give no rows;
    other columns are not looked at. Scores are exact as in top_k.

    Anchors are dealt to clusters by the nearest of at most CLUSTERS centres, fitted on at most SAMPLE anchors: the
    centres decide how far lists are walked, never what is found. Candidates are dealt to shards by hash and packed, one
    row a shard, and so are anchors, in blocks of whole clusters where these are small. Every block meets every shard in a
    task of its own, which sorts the shard's part of each cluster's list once; all members walk it until what is left
    can't help them. An eighth of the shards comes first, so that the rest start with good k-th scores. Positives are
    known before negatives are looked for.
    """
    label = vectors.schema["label"].dataType.simpleString()
    rows = settle(vectors.where("id is not null and label is not null and v is not null").select("id", "label", "v", is_anchor.alias("is_anchor"), F.monotonically_increasing_id().alias("row")))
    count = rows.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count.a:
        return rows.sparkSession.createDataFrame([], names)
    shards = max(1, math.ceil(count.n / shard_rows))
    anchors = rows.where("is_anchor")
    picked = sampled(anchors.select("row", "v"), ["row"], SAMPLE).toPandas()
    centre = centres(directions(matrix(picked["v"]))[0], min(CLUSTERS, max(1, count.a // 64)))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        unit = directions(matrix(v))[0]
        wide = min(unit.shape[1], centre.shape[1])
        return pd.Series((unit[:, :wide] @ centre[:, :wide].T).argmax(axis=1))

    anchors = settle(anchors.withColumn("cluster", nearest("v")))
    # whole clusters side by side in a block; a large one is cut by hash
    first, salts, held, block = [0] * len(centre), [1] * len(centre), 0, 0
    for r in anchors.groupBy("cluster").count().orderBy("cluster").collect():  # a row a cluster
        if held and held + r["count"] > block_anchors:
            block, held = block + 1, 0
        salts[r.cluster] = math.ceil(r["count"] / block_anchors)
        first[r.cluster] = block
        held += r["count"]
        if salts[r.cluster] > 1:
            block, held = block + salts[r.cluster], 0
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    blocks = block + 1
    anchors = anchors.withColumn("block", (at(first) + F.pmod(F.xxhash64("row"), at(salts).cast("long"))).cast("int"))
    packed = f"v binary, kind string, wide int, rows binary, ids binary, labels array<{label}>"
    own = rows.withColumn("shard", F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int"))
    candidates = settle(own.groupBy("shard").applyInPandas(_packed(["shard"]), f"shard int, {packed}"))
    blocked = settle(anchors.groupBy("block").applyInPandas(_packed(["block"]), f"block int, {packed}"))
    cut = (shards + 7) // 8
    waves = [w for w in ((0, cut - 1), (cut, shards - 1)) if w[0] <= w[1]]

    def visit(wave: tuple[int, int], known: DataFrame, meet) -> DataFrame:
        """What ``meet`` finds where blocks and the shards of a wave meet. ``known``: block, and what its anchors know by now."""
        step = F.explode(F.sequence(F.lit(wave[0]), F.lit(wave[1])))
        pairs = blocked.join(known, "block", "left").withColumn("step", step).withColumn("shard", F.pmod(F.col("block") + F.col("step"), F.lit(shards)))
        every = rows.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).withColumn("step", step)
        wanted = every.select("block", F.pmod(F.col("block") + F.col("step"), F.lit(shards)).alias("shard"))
        copies = candidates.join(wanted, "shard")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_row", "row", "id", "score")})
            return meet(Meeting(left.iloc[0], right.iloc[0], centre), left.iloc[0]["known"])

        return pairs.groupBy("block", "shard").cogroup(copies.groupBy("block", "shard")).applyInPandas(run, FOUND)

    def lined_up(m: Meeting, known, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor and slot of ``known``: a score and the k-th best so far."""
        score, least = np.full((len(m.q), slots), np.nan, m.q.dtype), np.full((len(m.q), slots), -np.inf, m.q.dtype)
        place = {r: i for i, r in enumerate(m.q_rows.tolist())}
        for x in known if known is not None else ():
            i = place[x["anchor_row"]]
            score[i, x["slot"]] = x["score"]
            if x["least"] is not None and x["least"] == x["least"]:
                least[i, x["slot"]] = x["least"]
        return score, least

    of_block = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), "block")

    def told(known: DataFrame) -> DataFrame:
        """``known`` (anchor_row, slot, score, least) as one row a block."""
        return known.join(of_block, "anchor_row").groupBy("block").agg(F.collect_list(F.struct("anchor_row", "slot", "score", "least")).alias("known"))

    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    none = rows.sparkSession.createDataFrame([], "anchor_row long, slot int, score long, least long")
    found = None
    for wave in waves:
        known = none if found is None else found.where(F.col("place") == positives).select("anchor_row", F.lit(0).alias("slot"), "score", F.col("score").alias("least"))
        got = visit(wave, told(known), lambda m, k: m.same_label(positives, lined_up(m, k, 1)[1][:, 0]))
        both = got if found is None else found.drop("place").unionByName(got)
        found = settle(both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
    positive = settle(found.select("anchor_row", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    def ranked(near: DataFrame) -> DataFrame:
        within = (low * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= high * F.col("positive_score"))
        each = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
        return positive.join(near, "anchor_row").where(within).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)

    near = None
    for wave in waves:
        known = positive.select("anchor_row", "slot", F.col("positive_score").alias("score"))
        if near is None:
            known = known.withColumn("least", F.lit(None).cast("long"))
        else:
            kth = ranked(near).where(F.col("rank") == negatives).select("anchor_row", "slot", F.col("score").alias("least"))
            known = known.join(kth, ["anchor_row", "slot"], "left")
        got = visit(wave, told(known), lambda m, k: m.other_labels(negatives, *lined_up(m, k, positives), low, high))
        near = settle(got if near is None else near.unionByName(got))
    return ranked(near).join(of_block, "anchor_row").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null and label is not null")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(rows, 256, moved.alias("label")), F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
