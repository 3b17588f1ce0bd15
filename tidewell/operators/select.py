"""Selecting units, trials, events and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import uniform

#: Brain structures of each class: fixed values.
MIDBRAIN = ["APN", "MB", "AT", "DT", "PPT", "NOT", "LT", "OP", "SC", "SCig", "SCiw", "SCzo", "SCsg", "SCop", "MRN", "RPF"]
HIPPOCAMPUS = ["HPF", "CA", "DG", "CA1", "CA2", "CA3", "ProS", "SUB", "POST", "PRE"]
THALAMUS = ["TH", "LGd", "LGv", "LP", "IGL", "PO", "POL", "SGN", "MGv", "MGm", "MGd", "VPM", "Eth", "VPL", "PP", "PIL", "IntG", "LD", "RT", "PF", "PoT"]
VISUAL = ["VIS", "VISam", "VISpm", "VISp", "VISl", "VISal", "VISrl", "VISmmp", "VISmma", "VISli"]


def select_units(units: DataFrame, areas: list[str], probes: list[str]) -> DataFrame:
    return units.where(F.col("area").isin(areas) & F.col("probe").isin(probes))


def select_trials(trials: DataFrame, conditions: list[int] | None = None, orientations: list[float] | None = None, frequencies: list[float] | None = None, baseline: bool = False) -> DataFrame:
    """By condition ids, by attributes (all given ones must fit), or the baseline trials, which have no orientation."""
    keep = F.lit(True)
    if conditions is not None:
        keep &= F.col("condition_id").isin(conditions)
    if orientations is not None:
        keep &= F.col("orientation").isin(orientations)
    if frequencies is not None:
        keep &= F.col("temporal_frequency").isin(frequencies)
    if baseline:
        keep &= F.col("orientation").isNull()
    return trials.where(keep)


def area_class(structure: Column) -> Column:
    return (
        F.when(structure.isin(MIDBRAIN), "midbrain").when(structure.isin(HIPPOCAMPUS), "hippocampus")
        .when(structure.isin(THALAMUS), "thalamus").when(structure.isin(VISUAL), "visual").otherwise("other")
    )


def pairs_with(membership: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows whose source is wanted, then rows whose target is; a row with both comes twice. One column each: unit_id."""
    by_source = membership.join(sources.select(F.col("unit_id").alias("src")), "src", "left_semi")
    by_target = membership.join(targets.select(F.col("unit_id").alias("dst")), "dst", "left_semi")
    return by_source.select("src", "dst", "trial_id", "group_id").unionAll(by_target.select("src", "dst", "trial_id", "group_id"))


def thin_edges(edges: DataFrame, probe_pairs: list[tuple[str, str]], ratio: float, seed: int = 0) -> DataFrame:
    """Edges of the probe pairs; of the significant ones all but a share ``ratio``, chosen by hash, are unmarked."""
    wanted = F.lit(False)
    for a, b in probe_pairs:
        wanted |= (F.col("src_probe") == a) & (F.col("dst_probe") == b)
    shown = uniform("src", "dst", seed) < ratio
    return edges.where(wanted).withColumn("significant", F.col("significant") & shown)


def plausible(models: DataFrame, most_beta: float = 100, most_h: float = 60) -> DataFrame:
    """Fits without an implausible coefficient or filter height; fits with NaN go too."""
    bad_h = lambda v: F.isnan(v) | (F.abs(v) > most_h)
    return models.where(F.forall("beta", lambda b: F.abs(b) <= most_beta) & ~F.exists("h", bad_h))


def dense_trials(membership: DataFrame, counts: DataFrame, least: int = 5) -> DataFrame:
    """Cells both of whose trains have more than ``least`` events."""
    enough = counts.where(F.col("n") > least).select("unit_id", "trial_id")
    return membership.join(enough.withColumnRenamed("unit_id", "src"), ["src", "trial_id"], "left_semi").join(
        enough.withColumnRenamed("unit_id", "dst"), ["dst", "trial_id"], "left_semi"
    )


def relabel(membership: DataFrame, groups: dict[int, int]) -> DataFrame:
    out = F.col("group_id")
    for old, new in groups.items():
        out = F.when(F.col("group_id") == old, new).otherwise(out)
    return membership.withColumn("group_id", out)


def active_units(rates: DataFrame, quantile: float = 0.7, within_probe: bool = True) -> DataFrame:
    """Units with a mean rate strictly above the (linear) quantile of all units, or of their probe. rates: unit_id, probe, rate."""
    if within_probe:
        floor = rates.groupBy("probe").agg(F.percentile("rate", F.lit(quantile)).alias("floor"))
        return rates.join(floor, "probe").where("rate > floor").drop("floor")
    floor = rates.agg(F.percentile("rate", F.lit(quantile)).alias("floor"))
    return rates.join(F.broadcast(floor), F.col("rate") > F.col("floor")).drop("floor")
