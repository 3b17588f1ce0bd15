"""Joins in time: events to trials, and events to events within a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(raw: DataFrame, trials: DataFrame, t0: int, t1: int) -> DataFrame:
    """(unit_id, trial_id, t_us) of events that fall in a trial's window [start + t0, start + t1).

    Both sides are cut into slots of the window's width, so the join is an equality on the slot with a range check:
    an event meets only the trials of its own slot, and neither side needs to be small.
    """
    width = t1 - t0
    slot = lambda c: F.floor(c / width)
    first = F.col("start_us") + t0
    windows = trials.select("trial_id", "start_us", F.explode(F.sequence(slot(first), slot(first + width - 1))).alias("slot"))
    events = raw.withColumn("slot", slot(F.col("ts_us")))
    t = F.col("ts_us") - F.col("start_us")
    return events.join(windows, "slot").where((t >= t0) & (t < t1)).select("unit_id", "trial_id", t.alias("t_us"))


def delays(x: DataFrame, y: DataFrame, low: int, high: int, keys: tuple[str, ...] = ("trial_id",), slot: int | None = None) -> DataFrame:
    """Every x row with every y row of the same keys with low < y.t_us - x.t_us <= high, and d = the difference.

    x: keys, t_us, other columns; y: keys, t_us, other columns; names besides the keys must differ, but for t_us,
    which comes out as x_us and y_us. x rows are copied to the slots that their reach touches (two or three), y rows
    are not, so a busy trial is spread over its slots and the work stays near the number of matches.
    """
    slot = slot or max(1, high - low)
    at = lambda c: F.floor(c / slot)
    reach = x.withColumnRenamed("t_us", "x_us").withColumn("slot", F.explode(F.sequence(at(F.col("x_us") + low + 1), at(F.col("x_us") + high))))
    events = y.withColumnRenamed("t_us", "y_us").withColumn("slot", at(F.col("y_us")))
    d = F.col("y_us") - F.col("x_us")
    return reach.join(events, [*keys, "slot"]).where((d > low) & (d <= high)).drop("slot").withColumn("d", d)


def pair_delays(points: DataFrame, pairs: DataFrame, low: int, high: int) -> DataFrame:
    """(src, dst, trial_id, x_us, y_us, d) for the wanted pairs of units. The pairs are met before the time join."""
    x = points.withColumnRenamed("unit_id", "src").join(pairs, "src").select("src", "dst", "trial_id", "t_us")
    y = points.withColumnRenamed("unit_id", "dst")
    return delays(x, y, low, high, ("dst", "trial_id"))
