"""Counts, bins and traces of units, groups and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit_trials(units: DataFrame, trials: DataFrame) -> DataFrame:
    """Every unit with every trial, one row each: the frame that gives empty trains their zeros."""
    return units.select("unit_id").join(trials.select("trial_id"))


def counts(points: DataFrame, frame: DataFrame) -> DataFrame:
    """(unit_id, trial_id, n) with zeros."""
    n = points.groupBy("unit_id", "trial_id").agg(F.count("*").alias("n"))
    return frame.join(n, ["unit_id", "trial_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bins(points: DataFrame, width: int, t0: int = 0, t1: int | None = None, keys: tuple[str, ...] = ("unit_id", "trial_id")) -> DataFrame:
    """(keys, bin, n): events per bin [t0 + b width, t0 + (b + 1) width), bins with events only.

    With ``t1`` the bins of the window are kept: ceil((t1 - t0) / width) of them; the last may reach past t1.
    """
    b = F.floor((F.col("t_us") - t0) / width)
    kept = points.where(F.col("t_us") >= t0)
    if t1 is not None:
        kept = kept.where(b < -(-(t1 - t0) // width))
    return kept.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def dense(sparse: DataFrame, frame: DataFrame, n_bins: int, value: str = "n") -> DataFrame:
    """The same with a row for every bin of every row of ``frame``."""
    keys = [*frame.columns, "bin"]
    full = frame.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return full.join(sparse, keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def trial_metric(points: DataFrame, frame: DataFrame, metric: str, width: int = 1, empty_fill: float | None = None) -> DataFrame:
    """Per unit and trial: ``count``, ``shift`` (mean time), ``spike_times`` (sorted array) or ``spike_trains`` (bins).

    Cells without events get ``empty_fill`` (counts and means) or an empty array.
    """
    if metric == "spike_trains":
        return bins(points, width)
    kinds = {"count": F.count("*").cast("double"), "shift": F.avg("t_us"), "spike_times": F.array_sort(F.collect_list("t_us"))}
    value = points.groupBy("unit_id", "trial_id").agg(kinds[metric].alias("value"))
    fill = F.array().cast("array<bigint>") if metric == "spike_times" else F.lit(empty_fill).cast("double")
    return frame.join(value, ["unit_id", "trial_id"], "left").withColumn("value", F.coalesce("value", fill))


def group_trace(points: DataFrame, groups: DataFrame, width: int, dt: float, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """(keys, trial_id, bin, psth): events of a group's units per bin, times dt. ``groups``: unit_id and the keys."""
    return bins(points.join(groups, "unit_id"), width, keys=(*keys, "trial_id")).withColumn("psth", F.col("n") * dt).drop("n")


def group_metric(points: DataFrame, groups: DataFrame, metric: str, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """(keys, trial_id, value): ``count`` or mean time (``shift``) over a group's events."""
    value = {"count": F.count("*").cast("double"), "shift": F.avg("t_us")}[metric]
    return points.join(groups, "unit_id").groupBy(*keys, "trial_id").agg(value.alias("value"))


def smooth(trace: DataFrame, keys: tuple[str, ...], value: str, n_bins: int, sigma: float) -> DataFrame:
    """Gaussian smoothing of a binned series, cut at 4 sigma, mirrored at the edges (the edge bin is repeated).

    Every bin sends its share to the bins in reach; what would land outside is folded back. Bins without a row are 0.
    """
    reach = int(4 * sigma + 0.5)
    weights = [F.exp(F.lit(-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)]
    total = sum(weights[1:], weights[0])
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), (w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), weights, strict=True)])
    around = F.pmod(F.col("bin") + F.col("at.k"), F.lit(2 * n_bins))
    folded = F.when(around < n_bins, around).otherwise(2 * n_bins - 1 - around)
    spread = trace.where(F.col(value) != 0).withColumn("at", F.explode(kernel))
    # a mirrored bin b' = -1 - b or 2 n - 1 - b carries b's value: sending to b + k and folding is the same sum
    return spread.groupBy(*keys, folded.alias("bin")).agg(F.sum(F.col(value) * F.col("at.w")).alias(value))


def probe_trace(unit_bins: DataFrame, units: DataFrame, dt: float) -> DataFrame:
    """(trial_id, probe, bin, rate): mean events per unit and second. Units without events count as well."""
    size = units.groupBy("probe").agg(F.count("*").alias("n_units"))
    total = unit_bins.join(units.select("unit_id", "probe"), "unit_id").groupBy("trial_id", "probe", "bin").agg(F.sum("n").alias("n"))
    return total.join(size, "probe").select("trial_id", "probe", "bin", (F.col("n") / F.col("n_units") / dt).alias("rate"))


def condition_tuning(cell_counts: DataFrame, trials: DataFrame, quantile: float = 0.8) -> DataFrame:
    """(condition_id, tuning, above_baseline, above_least): mean count of the units above the condition's quantile.

    above_baseline: less the baseline condition's (no orientation), at least 0; above_least: less the least, plus 0.1.
    """
    mean = cell_counts.join(trials, "trial_id").groupBy("condition_id", F.col("orientation").isNull().alias("is_baseline"), "unit_id").agg(F.avg("n").alias("mean_n"))
    floor = mean.groupBy("condition_id").agg(F.percentile("mean_n", F.lit(quantile)).alias("floor"))
    tuned = mean.join(floor, "condition_id").where("mean_n > floor").groupBy("condition_id", "is_baseline").agg(F.avg("mean_n").alias("tuning"))
    overall = tuned.agg(F.min("tuning").alias("least"), F.avg(F.when(F.col("is_baseline"), F.col("tuning"))).alias("base"))
    return tuned.join(F.broadcast(overall)).select(
        "condition_id", "tuning", F.greatest(F.col("tuning") - F.col("base"), F.lit(0.0)).alias("above_baseline"), (F.col("tuning") - F.col("least") + 0.1).alias("above_least")
    )


def condition_psth(unit_bins: DataFrame, cell_counts: DataFrame, units: DataFrame, trials: DataFrame, dt: float, quantile: float = 0.5, by: tuple[str, ...] = ("condition_id", "probe")) -> DataFrame:
    """(by, bin, rate) over the units whose mean count is strictly above the quantile of their condition and probe."""
    u, t = units.select("unit_id", "probe"), trials
    mean = cell_counts.join(u, "unit_id").join(t, "trial_id").groupBy(*by, "unit_id").agg(F.avg("n").alias("mean_n"), F.count("*").alias("n_trials"))
    floor = mean.groupBy(*by).agg(F.percentile("mean_n", F.lit(quantile)).alias("floor"))
    active = mean.join(floor, list(by)).where("mean_n > floor").select(*by, "unit_id", "n_trials")
    cells = active.groupBy(*by).agg(F.sum("n_trials").alias("cells"))
    n = unit_bins.join(u, "unit_id").join(t, "trial_id").join(active, [*by, "unit_id"], "left_semi").groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return n.join(cells, list(by)).select(*by, "bin", (F.col("n") / F.col("cells") / dt).alias("rate"))


def total_variation(trace: DataFrame, keys: tuple[str, ...], value: str = "rate") -> DataFrame:
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("bin"))
    return trace.withColumn("step", F.abs(step)).groupBy(*keys).agg(F.sum("step").alias("variation"))


def intervals(points: DataFrame) -> DataFrame:
    """(unit_id, trial_id, t_us, gap): time since the train's event before."""
    order = Window.partitionBy("unit_id", "trial_id").orderBy("t_us")
    return points.withColumn("gap", F.col("t_us") - F.lag("t_us").over(order))


def train_statistics(points: DataFrame, cell_counts: DataFrame, trial_seconds: float) -> DataFrame:
    """(unit_id, mean_n, var_n, rate, mean_gap): over all trials, empty ones too; gaps in microseconds."""
    gaps = intervals(points).groupBy("unit_id").agg(F.avg("gap").alias("mean_gap"))
    stats = cell_counts.groupBy("unit_id").agg(F.avg("n").alias("mean_n"), F.var_pop("n").alias("var_n"), (F.avg("n") / trial_seconds).alias("rate"))
    return stats.join(gaps, "unit_id", "left")


def empty_trials(cell_counts: DataFrame) -> DataFrame:
    return cell_counts.groupBy("unit_id").agg(F.count_if(F.col("n") == 0).alias("empty"))


def conditions(trials: DataFrame) -> DataFrame:
    """Attributes, trial ids and number of trials of every condition."""
    return trials.groupBy("condition_id").agg(
        F.array_sort(F.collect_set("orientation")).alias("orientations"), F.array_sort(F.collect_list("trial_id")).alias("trial_ids"),
        F.count("*").alias("n_trials"), F.max_by("contrast", "trial_id").alias("last_contrast"),
    )


def condition_sizes(trials: DataFrame) -> DataFrame:
    return trials.groupBy("condition_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("conditions"))


def significant_shares(tests: DataFrame) -> DataFrame:
    """(src_probe, dst_probe, n_pairs, n_significant, ratio) per probe pair and, with nulls, in all."""
    each = tests.groupBy("probes").agg(F.count("*").alias("n_pairs"), F.count_if("significant").alias("n_significant"))
    whole = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pairs", "n_significant")])  # a row without tests, too
    both = each.select("probes.src_probe", "probes.dst_probe", "n_pairs", "n_significant").unionByName(whole, allowMissingColumns=True)
    return both.withColumn("ratio", F.when(F.col("n_pairs") > 0, F.col("n_significant") / F.when(F.col("n_pairs") > 0, F.col("n_pairs"))).otherwise(F.lit(float("nan"))))
