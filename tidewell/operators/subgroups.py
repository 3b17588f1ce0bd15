"""Splitting units into the subgroups that carry a pathway's activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import settle


def split_by_correlation(corrs: DataFrame, least: float = 0.2, quantile: float = 0.3) -> DataFrame:
    """(unit_id, probe_from, probe_to, group_id): 0 for units whose correlations above ``least`` with the other probe
    add up to more than the quantile of their probe, else 1. corrs: src, dst, p0, p1, r."""
    strong = F.sum(F.when(F.col("r") > least, F.col("r")).otherwise(0.0)).alias("s")
    one = corrs.groupBy(F.col("src").alias("unit_id"), F.col("p0").alias("probe_from"), F.col("p1").alias("probe_to")).agg(strong)
    two = corrs.groupBy(F.col("dst").alias("unit_id"), F.col("p1").alias("probe_from"), F.col("p0").alias("probe_to")).agg(strong)
    sums = one.unionByName(two)
    floor = sums.groupBy("probe_from", "probe_to").agg(F.percentile("s", F.lit(quantile)).alias("floor"))
    above = F.round("s", 9) > F.round("floor", 9)  # sums in another order are still the same sum
    return sums.join(floor, ["probe_from", "probe_to"]).select("unit_id", "probe_from", "probe_to", F.when(above, 0).otherwise(1).alias("group_id"))


def match_scores(bins: DataFrame, psth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, keys, trial_id, score): dot product of a unit's bins with a group's trace on the same bins."""
    met = bins.join(psth, [*keys, "trial_id", "bin"])
    return met.groupBy("unit_id", *keys, "trial_id").agg(F.sum(F.col("n") * F.col("psth")).alias("score"))


def split_by_score(scores: DataFrame, quantile: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, keys, group_id): 0 above the quantile of the score, else 1."""
    floor = scores.groupBy(*keys).agg(F.percentile("score", F.lit(quantile)).alias("floor"))
    joined = scores.join(floor, list(keys)) if keys else scores.join(F.broadcast(floor))
    return joined.select("unit_id", *keys, F.when(F.col("score") > F.col("floor"), 0).otherwise(1).alias("group_id"))


def search(bins: DataFrame, units: DataFrame, start: DataFrame, rounds: int = 5, quantile: float = 0.6, enough: float = 0.99) -> DataFrame:
    """(unit_id, probe): per probe, units that match their group's trace best, found anew from the trace of the last
    group until the overlap with it exceeds ``enough`` or after ``rounds``. Groups are a few units, so a round's
    table is cut off from its plan by a checkpoint."""
    bins = bins.join(units.select("unit_id", "probe"), "unit_id")
    group = start.select("unit_id", "probe")
    for _ in range(rounds):
        psth = bins.join(group, ["unit_id", "probe"]).groupBy("probe", "trial_id", "bin").agg(F.sum("n").alias("psth"))
        scores = match_scores(bins, psth, ("probe",)).groupBy("unit_id", "probe").agg(F.sum("score").alias("score"))
        found = split_by_score(scores, quantile, ("probe",)).where("group_id = 0").select("unit_id", "probe")
        if enough <= 1:
            found = settle(found)
            shared = found.join(group, ["unit_id", "probe"], "left_semi").count()
            size = max(1, group.count())
            group = found
            if shared / size > enough:
                break
        else:
            group = found
    return group
