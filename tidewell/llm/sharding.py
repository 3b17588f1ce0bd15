"""Shards by a weighted hash tree: regions, racks, shards."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm._common import settle, table


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """``shards`` equal shards in racks and regions of a fixed size."""
    return [Shard(s // (per_rack * racks), s // per_rack % racks, s) for s in range(shards)]


def grow(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own.

    No other subtree's weight changes, so a row either stays or moves to the new shard.
    """
    return [*shards, Shard(max(s.region for s in shards) + 1, 0, max(s.shard for s in shards) + 1, weight)]


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: 52 bits of an MD5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def draw(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the least -ln(u) / weight: each wins with a chance in proportion to its weight, and a change of
    one child's weight moves rows only to or from that child."""
    tickets = [F.struct((-F.ln(uniform(key, F.lit(f"{level}{c}"))) / w).alias("t"), F.lit(c).alias("c")) for c, w in sorted(children.items()) if w > 0]
    return F.least(*tickets)["c"] if len(tickets) > 1 else tickets[0]["c"]


def place(key: Column, shards: list[Shard]) -> Column:
    """Descend from the root by one weighted draw a level; a subtree weighs what its shards weigh."""
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    leaves: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
    for s in shards:
        regions[s.region] += s.weight
        racks[s.region][s.rack] += s.weight
        leaves[s.region, s.rack][s.shard] = s.weight

    def choose(drawn: Column, options: dict[int, Column]) -> Column:
        *some, last = options.items()
        out = last[1]
        for n, column in some:
            out = F.when(drawn == n, column).otherwise(out)
        return out

    below = {
        g: choose(draw(key, f"region{g}/rack", racks[g]), {r: draw(key, f"region{g}/rack{r}/shard", leaves[g, r]) for r in racks[g]})
        for g in regions
    }
    return choose(draw(key, "region", regions), below)


def assign(docs: DataFrame, shards: list[Shard]) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    A row's doc_id and the tree alone decide its shard; null ids are a key of their own, and rows that share an id,
    or its hash, share a shard. A null text has size 1 and the digest of an empty one; texts are read whole. No rows
    give none; other columns are not looked at.

    Slots number a shard's rows from 0 by the id's MD5, then the text's digest and the size; equal rows follow one
    another. Rows are cut into ranges of this order, which ends with a row number, so neither a shard nor an id nor a
    row that is repeated many times is in one task; the ranges' counts give each its first slot.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(key).alias("m"), key.alias("key"))
    rows = rows.select(
        "doc_id", "size", "text_crc32", "m", place(F.col("key"), shards).alias("shard"), place(F.col("key"), grow(shards)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["m", "text_crc32", "size", "row"]
    dealt = settle(rows.repartitionByRange("shard", *order)).withColumn("part", F.spark_partition_id())
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy(*order)
    numbered = dealt.join(starts, ["shard", "part"]).withColumn("r", F.row_number().over(within))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("r") - 1).alias("slot"), "grown_shard",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"), tree(16))
