"""Result tables as Parquet and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_results(spark: SparkSession, paths: list[str], schema: StructType | str | None = None) -> DataFrame:
    """Many result files or globs stacked in one scan; columns that a file lacks are null."""
    reader = spark.read.option("mergeSchema", schema is None)
    return (reader.schema(schema) if schema else reader).parquet(*paths)


def write_results(edges: DataFrame, path: str, by: tuple[str, ...] = ("src_probe", "dst_probe")) -> None:
    """One folder a probe pair, dealt by it first so that a pair's rows make few files."""
    edges.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def save_steps(models: DataFrame, path: str) -> None:
    """Models or memberships by iteration and trial; overwrites only the partitions that ``models`` holds."""
    models.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("itr", "trial_id").parquet(path)


def load_steps(spark: SparkSession, path: str, itrs: list[int] | None = None, trial_ids: list[int] | None = None, last_only: bool = False) -> DataFrame:
    """The asked iterations and trials, pruned to their folders; ``last_only``: each trial's last iteration."""
    found = spark.read.parquet(path)
    if itrs is not None:
        found = found.where(F.col("itr").isin(itrs))
    if trial_ids is not None:
        found = found.where(F.col("trial_id").isin(trial_ids))
    if last_only:
        last = found.groupBy("trial_id").agg(F.max("itr").alias("itr"))
        found = found.join(F.broadcast(last), ["itr", "trial_id"], "left_semi")
    return found
