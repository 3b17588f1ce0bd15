"""The given tables as points, units and trials.

points(unit_id, trial_id, t_us): one row an event, microseconds from the trial's start. Time is whole microseconds
throughout, so bins and lags never depend on rounding. A trial is a day, a unit is a user group and an event type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
MINUTE = 60_000_000
HOUR = 60 * MINUTE
KINDS = ["click", "error", "purchase", "signup", "view"]
#: Area of each probe, in the order of the probes: fixed values of the recordings.
AREAS = ["VISam", "VISpm", "VISp", "VISl", "VISal", "VISrl"]

#: The same tables in SQL.
BASE = """
points AS (SELECT CAST(user_id % 6 * 10 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS unit_id,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS trial_id, CAST(epoch_us(ts) % 86400000000 AS BIGINT) AS t_us FROM events),
units AS (SELECT DISTINCT unit_id, 'probe' || chr(CAST(65 + unit_id // 10 AS INTEGER)) AS probe,
  ['VISam', 'VISpm', 'VISp', 'VISl', 'VISal', 'VISrl'][CAST(unit_id // 10 + 1 AS INTEGER)] AS area FROM points),
trials AS (SELECT DISTINCT trial_id, trial_id * 86400000000 AS start_us, trial_id % 5 AS condition_id,
  CASE WHEN trial_id % 5 < 4 THEN CAST(45.0 * (trial_id % 5) AS DOUBLE) END AS orientation, CASE WHEN trial_id % 5 < 4 THEN CAST(4.0 AS DOUBLE) END AS temporal_frequency, CAST(1.0 AS DOUBLE) AS contrast FROM points),
grid AS (SELECT unit_id, trial_id FROM units, trials),
counts AS (SELECT g.unit_id, g.trial_id, count(p.t_us) AS n FROM grid g LEFT JOIN points p ON p.unit_id = g.unit_id AND p.trial_id = g.trial_id GROUP BY ALL),
bins AS (SELECT unit_id, trial_id, t_us // 300000000 AS bin, count(*) AS n FROM points GROUP BY ALL),
pairs AS (SELECT a.unit_id AS src, b.unit_id AS dst FROM units a JOIN units b ON a.unit_id < b.unit_id AND a.probe <> b.probe)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only three columns of the events are read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = reduce(lambda out, i: out.when(F.col("event_type") == KINDS[i], i), range(1, 4), F.when(F.col("event_type") == KINDS[0], 0)).otherwise(4)
    second = F.expr("cast(extract(SECOND FROM ts) * 1000000 as bigint)")
    return events.select(
        (F.col("user_id") % 6 * 10 + kind).cast("long").alias("unit_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("trial_id"),
        ((F.hour("ts") * 60 + F.minute("ts")).cast("long") * MINUTE + second).alias("t_us"),
    )


def points_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the session's clock, before they are aligned to trials."""
    return points(spark, sf_dir).select("unit_id", (F.col("trial_id") * DAY + F.col("t_us")).alias("ts_us"))


def units(pts: DataFrame) -> DataFrame:
    probe = (F.col("unit_id") / 10).cast("int")
    return pts.select("unit_id").distinct().select(
        "unit_id", F.concat(F.lit("probe"), F.char(65 + probe)).alias("probe"), F.element_at(F.array(*map(F.lit, AREAS)), probe + 1).alias("area")
    )


def trials(pts: DataFrame) -> DataFrame:
    condition: Column = F.col("trial_id") % 5
    return pts.select("trial_id").distinct().select(
        "trial_id", (F.col("trial_id") * DAY).alias("start_us"), condition.alias("condition_id"),
        F.when(condition < 4, 45.0 * condition).alias("orientation"), F.when(condition < 4, F.lit(4.0)).alias("temporal_frequency"), F.lit(1.0).alias("contrast"),
    )
