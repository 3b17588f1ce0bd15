"""Pairs of units, and the trains of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import uniform


def unit_pairs(units: DataFrame, kind: str = "between_probe", probe_pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(src, dst): ``all`` and ``within_probe`` pairs once each (src < dst); ``between_probe`` pairs once each too, or,
    with ``probe_pairs``, all pairs from the first to the second probe, in that order."""
    a = units.select(F.col("unit_id").alias("src"), F.col("probe").alias("src_probe"))
    b = units.select(F.col("unit_id").alias("dst"), F.col("probe").alias("dst_probe"))
    if probe_pairs:
        wanted = units.sparkSession.createDataFrame(probe_pairs, "src_probe string, dst_probe string")
        return a.join(F.broadcast(wanted), "src_probe").join(b, "dst_probe").select("src", "dst")
    if kind == "within_probe":
        return a.join(b, a.src_probe == b.dst_probe).where("src < dst").select("src", "dst")
    probes = units.select(F.col("probe").alias("src_probe")).distinct()
    met = F.lit(True) if kind == "all" else F.col("src_probe") != F.col("dst_probe")
    wanted = probes.join(probes.withColumnRenamed("src_probe", "dst_probe"), met)  # a row a pair of probes
    return a.join(wanted, "src_probe").join(b, "dst_probe").where("src < dst").select("src", "dst")


def with_attributes(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Source and target probe and area beside every edge; edges of unknown units go."""
    for end in ("src", "dst"):
        side = units.select(F.col("unit_id").alias(end), F.col("probe").alias(f"{end}_probe"), F.col("area").alias(f"{end}_area"))
        edges = edges.join(side, end)
    return edges


def init_membership(pairs: DataFrame, counts: DataFrame, groups: int = 5, random: bool = True, seed: int = 0) -> DataFrame:
    """(src, dst, trial_id, group_id): a group by hash (or 0) for every pair and trial; null where a train is empty.

    ``counts``: unit_id, trial_id, n, with zero rows.
    """
    group = F.floor(uniform("src", "dst", "trial_id", seed) * groups).cast("int") if random else F.lit(0)
    x = counts.select(F.col("unit_id").alias("src"), "trial_id", F.col("n").alias("nx"))
    y = counts.select(F.col("unit_id").alias("dst"), "trial_id", F.col("n").alias("ny"))
    return pairs.join(x, "src").join(y, ["dst", "trial_id"]).select(
        "src", "dst", "trial_id", F.when((F.col("nx") > 0) & (F.col("ny") > 0), group).alias("group_id")
    )


def stack_cells(membership: DataFrame, group_id: int | None = None, batch: int | None = None, seed: int = 0) -> DataFrame:
    """The (pair, trial) cells of a group, or of all groups; of these the first ``batch`` by hash, as a sample."""
    cells = membership.where(F.col("group_id") == group_id if group_id is not None else F.col("group_id") >= 0)
    if batch is not None:
        cells = cells.orderBy(uniform("src", "dst", "trial_id", seed), "src", "dst", "trial_id").limit(batch)
    return cells


def cell_trains(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, trial_id, side, t_us): both trains of every cell, x for the source and y for the target."""
    sides = [
        cells.select("src", "dst", "trial_id").join(points.withColumnRenamed("unit_id", end), [end, "trial_id"]).select("src", "dst", "trial_id", F.lit(side).alias("side"), "t_us")
        for end, side in (("src", "x"), ("dst", "y"))
    ]
    return sides[0].unionAll(sides[1])


#: Pairs of a pathway in a block of the grid, and 62-trial words of a bitmap.
BLOCK_PAIRS, WORDS = 256, 16


def shared_cells(membership: DataFrame, pathway0: DataFrame, pathway1: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(src0, dst0, src1, dst1, cat0, cat1, n): trials in which a pair of one pathway has cat0 and one of the other cat1.

    The trials of a pair and category are packed into a bitmap first, so the pathways meet once a pair of pairs, not once
    a trial, and the count is a population count. Both pathways are dealt to blocks of about ``block_pairs`` pairs, and
    every block of one meets every block of the other under a key of its own: a task sees two blocks, however many
    pairs there are and however few trials. Trials beyond WORDS words of 62 have bitmaps, and keys, of their own.
    """
    def packed(pathway: DataFrame, i: int) -> tuple[DataFrame, int]:
        cells = membership.where("group_id is not null").join(pathway, ["src", "dst"], "left_semi")
        blocks = max(1, -(-pathway.count() // block_pairs))
        word = F.floor(F.col("trial_id") / 62)
        words = cells.groupBy("src", "dst", "group_id", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(trial_id, 62) as int))")).alias("bits"))
        place, chunk = F.pmod("word", F.lit(WORDS)).cast("int"), F.floor(F.col("word") / WORDS)
        held = words.groupBy("src", "dst", "group_id", chunk.alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(place, "bits"))).alias("held"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.element_at("held", w), F.lit(0).cast("long")))
        one = held.groupBy("src", "dst", "chunk").agg(F.collect_list(F.struct(F.col("group_id").alias("cat"), dense.alias("bits"))).alias(f"cats{i}"))
        block = F.pmod(F.xxhash64("src", "dst"), F.lit(blocks)).cast("int")
        return one.select(F.col("src").alias(f"src{i}"), F.col("dst").alias(f"dst{i}"), "chunk", f"cats{i}", block.alias(f"block{i}")), blocks

    (left, n_left), (right, n_right) = packed(pathway0, 0), packed(pathway1, 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = left.withColumn("block1", every(n_right)).join(right.withColumn("block0", every(n_left)), ["block0", "block1", "chunk"])
    common = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    table = F.flatten(F.transform("cats0", lambda a: F.transform("cats1", lambda b: F.struct(a["cat"].alias("cat0"), b["cat"].alias("cat1"), common(a["bits"], b["bits"]).alias("n")))))
    cells = met.select("src0", "dst0", "src1", "dst1", F.explode(table).alias("c")).select("src0", "dst0", "src1", "dst1", "c.*").where("n > 0")
    return cells.groupBy("src0", "dst0", "src1", "dst1", "cat0", "cat1").agg(F.sum("n").alias("n"))


def strongest_block(cells: DataFrame, least: int = 20) -> DataFrame:
    """Cells of at least ``least`` trials, the largest first; ties by ids."""
    return cells.where(F.col("n") >= least).orderBy(F.desc("n"), "src0", "dst0", "src1", "dst1", "cat0", "cat1")


def trials_of_cell(membership: DataFrame, cell: DataFrame) -> DataFrame:
    """(trial_id, src0, dst0, src1, dst1) of the trials in which both pairs of each given cell carry its categories."""
    m0 = membership.select(F.col("src").alias("src0"), F.col("dst").alias("dst0"), "trial_id", F.col("group_id").alias("cat0"))
    m1 = membership.select(F.col("src").alias("src1"), F.col("dst").alias("dst1"), "trial_id", F.col("group_id").alias("cat1"))
    return cell.join(m0, ["src0", "dst0", "cat0"]).join(m1, ["src1", "dst1", "cat1", "trial_id"]).select("trial_id", "src0", "dst0", "src1", "dst1")
