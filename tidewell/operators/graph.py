"""Coupling graphs as tables of nodes and edges, and clusters of correlograms and filters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signed_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of the significant edges: the sign of their effect."""
    return edges.where("significant").select("src", "dst", F.when(F.col("h") > 0, 1).otherwise(-1).alias("weight"))


def unit_edges(significant: DataFrame) -> DataFrame:
    return significant.where("up or down").select("src", "dst", F.lit(1).alias("weight"))


def probe_graph(edges: DataFrame) -> DataFrame:
    return edges.where("significant").groupBy("src_probe", "dst_probe").agg(F.count("*").alias("weight"))


def weighted_degree(membership: DataFrame) -> DataFrame:
    """(unit_id, degree): sum of group ids over a unit's pairs, in both directions."""
    cells = membership.where("group_id is not null")
    ends = cells.select(F.col("src").alias("unit_id"), "group_id").unionAll(cells.select("dst", "group_id"))
    return ends.groupBy("unit_id").agg(F.sum("group_id").alias("degree"))


def degrees(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, probe, degree): different neighbours of every unit, 0 for isolated ones; direction is ignored."""
    once = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = once.select(F.col("a").alias("unit_id")).unionAll(once.select("b"))
    n = ends.groupBy("unit_id").agg(F.count("*").alias("degree"))
    return units.join(n, "unit_id", "left").select("unit_id", "probe", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_statistics(degree: DataFrame, hub: int = 6) -> DataFrame:
    """(probe, n_units, nonzero, hubs, mean_degree)."""
    return degree.groupBy("probe").agg(F.count("*").alias("n_units"), F.avg((F.col("degree") > 0).cast("double")).alias("nonzero"), F.count_if(F.col("degree") > hub).alias("hubs"), F.avg("degree").alias("mean_degree"))


def hubs(degree: DataFrame, least: int) -> DataFrame:
    return degree.where(F.col("degree") >= least)


def sorted_nodes(degree: DataFrame) -> DataFrame:
    """(probe, rank, unit_id, degree): by degree, largest first, within each probe; ties by id."""
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("degree"), "unit_id"))
    return degree.select("probe", rank.alias("rank"), "unit_id", "degree")


def edge_signs(edges: DataFrame) -> DataFrame:
    return edges.groupBy("significant", (F.col("h") > 0).alias("positive")).agg(F.count("*").alias("n"))


def unify_direction(series: DataFrame, value: str = "y") -> DataFrame:
    """Correlograms (src, dst, y array over lags -L to L): those with more on the left are turned round."""
    half = F.floor(F.size(value) / 2).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    left, right = total(F.slice(value, F.lit(1), half)), total(F.slice(value, F.size(value) - half + 1, half))
    return series.withColumn(value, F.when(right < left, F.reverse(value)).otherwise(F.col(value)))


def cluster(rows: DataFrame, value: str, k: int, seed: int = 1, least: int = 3) -> DataFrame:
    """The same rows with a cluster number: k-means of the arrays, k at most their number; fewer than ``least`` rows
    are one cluster."""
    n = rows.limit(max(k, least)).count()
    if n < least:
        return rows.withColumn("cluster", F.lit(0))
    vectors = rows.withColumn("features", array_to_vector(F.col(value).cast("array<double>")))
    model = KMeans(k=min(k, n), seed=seed, predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("features")


def cluster_means(clustered: DataFrame, value: str) -> DataFrame:
    """(cluster, pos, mean_value, n)."""
    return clustered.select("cluster", F.posexplode(value)).groupBy("cluster", "pos").agg(F.avg("col").alias("mean_value"), F.count("*").alias("n"))
