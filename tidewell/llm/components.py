"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import settle

#: Parts into which the rows of a hub or of a large component are dealt where they meet a value of their own.
SALTS = 8


def meet(rows: DataFrame, key: str, spread: str, values: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``values``, one row a ``key``, with the rows of a key dealt to SALTS tasks by ``spread``."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "salt"], how).drop("salt")


def with_least(member: DataFrame, node: str, value: str) -> DataFrame:
    """``member`` (a node, component or null for a node without links, ...) with component_id: the component's least
    ``value``, and component never null. Minima are combined before they are shuffled; rows of a large component meet
    theirs in several tasks."""
    alone = member.where("component is null").withColumns({"component": F.col(node), "component_id": F.col(value)})
    linked = member.where("component is not null")
    least = linked.groupBy("component").agg(F.min(value).alias("component_id"))
    return meet(linked, "component", node, least).select(alone.columns).unionByName(alone)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one. ``edges``: (a, b) with a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))  # a node that is only ever a ``b`` is its own smallest
    return meet(both.where("b > a"), "a", "b", least, "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    onward = meet(edges, "a", "b", least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(onward).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; ``links`` holds two columns of one orderable type.

    The component is the smallest node in it. Rows with a null end and links from a node to itself name no other
    node and are left out. A hub's rows meet its minimum in several tasks; the minima are combined before they are
    shuffled. Each round is written to the checkpoint folder; rounds end when one changes nothing, which they all reach, as
    links only ever move to smaller nodes.
    """
    x, y = links.columns
    edges = settle(
        links.where(f"{x} <> {y}").select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    )
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = digest(edges)
    while before[0]:
        edges = settle(_small_star(_large_star(edges)))
        now = digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
