"""Tests over many pairs: adjusted p-values, contingency, block patterns, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.columns import chi2_tail, norm_cdf, uniform
from tidewell.sources.shared import settle


def wald_p(beta: Column, se: Column) -> Column:
    """Two-sided p of beta / se."""
    c = norm_cdf(beta / se)
    return 2 * F.least(c, 1 - c)


def rank_p(raw: DataFrame, surrogate: DataFrame) -> DataFrame:
    """(src, dst, h, p): two-sided rank of a filter height among surrogate fits (src, dst, rep, h)."""
    both = raw.join(surrogate.withColumnRenamed("h", "h_jit"), ["src", "dst"])
    below = F.avg(F.when(F.col("h") > F.col("h_jit"), 1.0).otherwise(0.0))
    return both.groupBy("src", "dst", "h").agg(below.alias("q")).select("src", "dst", "h", (2 * F.least("q", 1 - F.col("q"))).alias("p"))


def adjust(tests: DataFrame, family: tuple[str, ...] = (), p: str = "p") -> DataFrame:
    """The same rows with bonferroni, bh and by: adjusted p-values within each family. Null p-values stay null.

    Equal p-values are counted first. Ranks are running sums over p and the minima run from the largest p back. Every
    family is cut into 256 stretches of p, whose counts and minima make the running values of the next, so a family
    is never in one task. The tests are settled first, as both sides of the last join are made of them.
    """
    tests = settle(tests)
    keys = [F.col(k) for k in family]
    stretch = F.least(F.floor(F.sqrt(F.sqrt(p)) * 256), F.lit(255)).alias("stretch")
    distinct = tests.where(F.col(p).isNotNull()).groupBy(*keys, stretch, F.col(p).alias("q")).agg(F.count("*").alias("c"))
    total = distinct.groupBy(*keys).agg(F.sum("c").alias("m"))
    m = F.col("m")
    added = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(10_000))), F.lit(0.0), lambda a, i: a + 1 / i)
    series = F.ln(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)  # exact to the last digit from 10,000 on
    total = total.withColumn("h", F.when(m <= 10_000, added).otherwise(series))
    one = lambda *c: Window.partitionBy(*(family or (F.lit(0),)), *c)
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    counts = distinct.groupBy(*keys, "stretch").agg(F.sum("c").alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(one().orderBy("stretch").rowsBetween(*before)), F.lit(0))).drop("n")
    joined = distinct.join(counts, [*family, "stretch"])
    joined = joined.join(total, list(family)) if family else joined.join(F.broadcast(total))
    ranked = joined.withColumn("rank", F.col("first") + F.sum("c").over(one("stretch").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("v", F.col("q") * F.col("m") / F.col("rank"))
    lows = ranked.groupBy(*keys, "stretch").agg(F.min("v").alias("low"))
    lows = lows.withColumn("later", F.min("low").over(one().orderBy("stretch").rowsBetween(*after))).drop("low")
    own = F.min("v").over(one("stretch").orderBy("q").rowsBetween(0, Window.unboundedFollowing))
    done = ranked.join(lows, [*family, "stretch"]).withColumn("v", F.least(own, F.coalesce("later", F.lit(1e308))))
    cap = lambda c: F.least(c, F.lit(1.0))
    done = done.select(*keys, F.col("q").alias(p), cap(F.col("q") * F.col("m")).alias("bonferroni"), cap(F.col("v")).alias("bh"), cap(F.col("v") * F.col("h")).alias("by"))
    return tests.join(done, [*family, p], "left")


def contingency_tests(cells: DataFrame) -> DataFrame:
    """(src0, dst0, src1, dst1, n, chi2, dof, cramer_v, p) of every pair of pairs from cells (..., cat0, cat1, n).

    Empty rows and columns are no part of a table. Absent cells add their expected count. Yates' correction applies
    at one degree of freedom; with none, chi2 is 0 and p 1.
    """
    pair = ["src0", "dst0", "src1", "dst1"]
    w = Window.partitionBy(*pair)
    r, c, n = F.sum("n").over(w.partitionBy(*pair, "cat0")), F.sum("n").over(w.partitionBy(*pair, "cat1")), F.sum("n").over(w)
    seen = cells.select(*pair, "cat0", "cat1", "n", r.alias("r"), c.alias("c"), n.alias("total"))
    expected = F.col("r") * F.col("c") / F.col("total")
    o = F.col("n")
    tables = seen.groupBy(*pair).agg(
        F.first("total").alias("total"), F.count_distinct("cat0").alias("rows"), F.count_distinct("cat1").alias("cols"),
        F.sum((o - expected) ** 2 / expected - expected).alias("seen"), F.sum(F.lit(1)).alias("cells"),
        F.sum(expected).alias("covered"), F.array_sort(F.collect_list(F.struct("cat0", "cat1", "n", "r", "c"))).alias("all"),
    ).withColumn("dof", (F.col("rows") - 1) * (F.col("cols") - 1))
    # sum over present cells of (o-e)^2/e, plus the expected counts of the absent ones, which are total - covered
    plain = F.col("seen") + F.col("covered") + F.col("total") - F.col("covered")
    # a 2 x 2 table: |ad - bc| from any present cell, as |n total - r c| is the same for all four
    gap = F.abs(F.col("all")[0]["n"] * F.col("total") - F.col("all")[0]["r"] * F.col("all")[0]["c"]) / F.col("total")
    r0, c0 = F.col("all")[0]["r"], F.col("all")[0]["c"]
    inverse = F.col("total") ** 3 / (r0 * (F.col("total") - r0) * c0 * (F.col("total") - c0))
    yates = (F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))) ** 2 * inverse
    chi2 = F.when(F.col("dof") == 0, 0.0).when(F.col("dof") == 1, yates).otherwise(plain)
    return tables.select(*pair, F.col("total").alias("n"), chi2.alias("chi2"), F.col("dof").cast("int").alias("dof")).withColumn("cramer_v", F.sqrt(F.col("chi2") / F.col("n") / 5))


def chi2_p(tests: DataFrame) -> DataFrame:
    """The same with p, the upper tail of chi2 at dof, to 9 digits."""
    return tests.withColumn("p", F.round(chi2_tail(F.col("chi2"), F.col("dof")), 9))


def p_levels(p: Column) -> Column:
    return F.when(p < 0.01, 2).when(p < 0.05, 1)


def p_summary(tests: DataFrame, thresholds: list[float], p: str = "p") -> DataFrame:
    """(threshold, n, ratio) of p-values below each threshold."""
    at = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return tests.select(p, at).groupBy("threshold").agg(F.count_if(F.col(p) < F.col("threshold")).alias("n"), F.avg(F.when(F.col(p) < F.col("threshold"), 1.0).otherwise(0.0)).alias("ratio"))


def hub_blocks(tests: DataFrame, alpha: float, fraction: float, block_cells: int) -> DataFrame:
    """(mid, n, n_src): pathways that meet in one unit (dst0 = src1) with more than fraction x block_cells links."""
    hit = tests.where((F.col("p") < alpha) & (F.col("dst0") == F.col("src1")))
    return hit.groupBy(F.col("dst0").alias("mid")).agg(F.count("*").alias("n"), F.count_distinct("src0").alias("n_src")).where(F.col("n") > fraction * block_cells)


def hub_members(tests: DataFrame, hubs: DataFrame, alpha: float) -> DataFrame:
    """(mid, src0, dst1, p): the pairs of pathways of each hub, one row each."""
    hit = tests.where((F.col("p") < alpha) & (F.col("dst0") == F.col("src1"))).withColumnRenamed("dst0", "mid")
    return hit.join(hubs, "mid", "left_semi").select("mid", "src0", "dst1", "p")


def broadcast_blocks(tests: DataFrame, alpha: float, fraction: float, block_cells: int) -> DataFrame:
    """(source, target, n, n_hub): pathways from one source to one target; n_hub of them run through one middle unit."""
    hit = tests.where(F.col("p") < alpha)
    return hit.groupBy(F.col("src0").alias("source"), F.col("dst1").alias("target")).agg(F.count("*").alias("n"), F.count_if(F.col("dst0") == F.col("src1")).alias("n_hub")).where(F.col("n") > fraction * block_cells)


def mean_contingency(cells: DataFrame, tests: DataFrame, alpha: float) -> DataFrame:
    """(cat0, cat1, mean_n, mean_n_significant): mean tables over all pairs of pairs and over the significant ones."""
    pair = ["src0", "dst0", "src1", "dst1"]
    size = tests.agg(F.count("*").alias("m"), F.count_if(F.col("p") < alpha).alias("ms"))
    joined = cells.join(tests.select(*pair, "p"), pair)
    sums = joined.groupBy("cat0", "cat1").agg(F.sum("n").alias("s"), F.sum(F.when(F.col("p") < alpha, F.col("n")).otherwise(0)).alias("ss"))
    return sums.join(F.broadcast(size)).select("cat0", "cat1", (F.col("s") / F.col("m")).alias("mean_n"), F.when(F.col("ms") > 0, F.col("ss") / F.when(F.col("ms") > 0, F.col("ms"))).alias("mean_n_significant"))


def in_significant(pairs: DataFrame, tests: DataFrame, alpha: float) -> DataFrame:
    """(src, dst, marked, degree): whether a pair is in a significant pair of pairs, and in how many."""
    hit = tests.where(F.col("p") < alpha)
    ends = hit.select(F.col("src0").alias("src"), F.col("dst0").alias("dst")).unionAll(hit.select("src1", "dst1"))
    degree = ends.groupBy("src", "dst").agg(F.count("*").alias("degree"))
    return pairs.join(degree, ["src", "dst"], "left").select("src", "dst", F.col("degree").isNotNull().cast("int").alias("marked"), F.coalesce("degree", F.lit(0)).alias("degree"))


def bootstrap_table(table: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """(cat0, cat1, n, p): one contingency table (cat0, cat1, n) against tables drawn from its margins.

    Every draw of every replicate is a row with a hash uniform for its row and its column, looked up in the
    cumulative margins.
    """
    def margin(cat: str) -> DataFrame:
        n = table.groupBy(cat).agg(F.sum("n").alias("s"))
        one = Window.partitionBy(F.lit(0)).orderBy(cat)
        upto = F.sum("s").over(one.rowsBetween(Window.unboundedPreceding, 0))
        return n.select(cat, ((upto - F.col("s")) / F.sum("s").over(Window.partitionBy(F.lit(0)))).alias(f"lo_{cat}"), (upto / F.sum("s").over(Window.partitionBy(F.lit(0)))).alias(f"hi_{cat}"))

    total = table.agg(F.sum("n").alias("total"))
    draws = total.select(F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), "total").select("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total"))).alias("i"))
    drawn = draws.select("rep", uniform("rep", "i", F.lit("row"), seed).alias("u0"), uniform("rep", "i", F.lit("col"), seed).alias("u1"))
    for cat, u in (("cat0", "u0"), ("cat1", "u1")):
        m = F.broadcast(margin(cat))
        drawn = drawn.join(m, (F.col(u) >= F.col(f"lo_{cat}")) & (F.col(u) < F.col(f"hi_{cat}")))
    made = drawn.groupBy("rep", "cat0", "cat1").agg(F.count("*").alias("b"))
    full = table.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).join(made, ["rep", "cat0", "cat1"], "left").withColumn("b", F.coalesce("b", F.lit(0)))
    right = F.avg(F.when(F.col("b") >= F.col("n"), 1.0).otherwise(0.0))
    return full.groupBy("cat0", "cat1", "n").agg(right.alias("r")).select("cat0", "cat1", "n", F.least("r", 1 - F.col("r")).alias("p"))


def bootstrap_errors(sample: DataFrame, reps: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(scenario, bias, se, rmse and their ci_lo, ci_hi) of estimates (scenario, i from 0, x, x0).

    A replicate's slot draws the row number by hash and joins it; its moments are aggregates of the joined rows.
    """
    size = sample.groupBy("scenario").agg(F.count("*").alias("size"))
    slots = sample.select("scenario", F.col("i").alias("slot")).join(size, "scenario").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    picks = slots.withColumn("i", F.floor(uniform("scenario", "rep", "slot", seed) * F.col("size")).cast("long")).select("scenario", "rep", "i")
    e = F.col("x") - F.col("x0")
    moments = [F.avg(e).alias("bias"), F.stddev_pop("x").alias("se"), F.sqrt(F.avg(e * e)).alias("rmse")]
    reps_ = picks.join(sample, ["scenario", "i"]).groupBy("scenario", "rep").agg(*moments)
    bands = [F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("bias", "se", "rmse") for n, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))]
    return sample.groupBy("scenario").agg(*moments).join(reps_.groupBy("scenario").agg(*bands), "scenario")


def ecdf(values: DataFrame, n_bins: int, keys: tuple[str, ...] = (), value: str = "p", alpha: float = 0.05) -> DataFrame:
    """(keys, bin, q, ecdf, band): share of values <= q on a grid of n_bins over [0, 1], with the Kolmogorov-Smirnov band;
    no rows without values."""
    b = F.ceil(F.col(value) * n_bins)
    b = b - (F.col(value) <= (b - 1) / n_bins).cast("int") + (F.col(value) > b / n_bins).cast("int")  # the product may round past a whole number
    b = F.greatest(b, F.lit(1)).cast("int").alias("bin")
    n = values.where(F.col(value).isNotNull()).groupBy(*keys, b).agg(F.count("*").alias("n"))
    frame = (n.select(*keys).distinct() if keys else values.sparkSession.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n_bins))))
    full = frame.join(n, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    part = Window.partitionBy(*(keys or (F.lit(0),)))
    upto = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(part)
    half = F.sqrt(-F.ln(F.lit(alpha / 2)) / 2) / F.sqrt("total")
    return full.withColumns({"upto": upto, "total": total}).where("total > 0").select(*keys, "bin", (F.col("bin") / n_bins).alias("q"), (F.col("upto") / F.col("total")).alias("ecdf"), half.alias("band"))


def interpolated(grid: DataFrame, table: DataFrame, x: str, y: str, at: str) -> DataFrame:
    """``grid`` with ``y``: the function of ``table`` (x, y), straight between its points and constant beyond them, at ``at``.

    Points of both are sorted together; each place takes the last point at or before it and the first at or after it from
    running windows, so both may have any grid. The sort is over one row a point of a distribution.
    """
    both = grid.select(F.col(at).alias("x"), F.lit(None).cast("double").alias("y")).distinct().unionByName(table.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    order = Window.partitionBy(F.lit(0)).orderBy("x")
    point = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    lines = both.withColumns({
        "a": F.last(point, True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "b": F.first(point, True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
    }).where("y is null")
    a, b = F.col("a"), F.col("b")
    between = a["y"] + (F.col("x") - a["x"]) / F.when(b["x"] > a["x"], b["x"] - a["x"]) * (b["y"] - a["y"])
    value = F.when(a.isNull(), b["y"]).when(b.isNull() | (b["x"] == a["x"]), a["y"]).otherwise(between)
    return grid.join(F.broadcast(lines.select(F.col("x").alias(at), value.alias(y))), at)


def ks_outside(values: DataFrame, n_bins: int, keys: tuple[str, ...], value: str = "u", alpha: float = 0.05, null: DataFrame | None = None) -> DataFrame:
    """(keys, outside): grid points at which the ECDF leaves the band around the diagonal, or around a ``null`` distribution
    given as a table (q, cdf) on a grid of its own, between whose points it is straight."""
    curve = ecdf(values, n_bins, keys, value, alpha)
    if null is None:
        model, slack = F.col("q"), 0.0
    else:
        curve, model, slack = interpolated(curve, null, "q", "cdf", "q"), F.col("cdf"), 1e-12
    return curve.groupBy(*keys).agg(F.count_if(F.abs(F.col("ecdf") - model) > F.col("band") + slack).alias("outside"))


def normal_qq(values: DataFrame, mean: float, sd: float, points: int = 41, span: float = 4.0, alpha: float = 0.05) -> DataFrame:
    """(i, z, ecdf, normal, band): empirical against Normal distribution at z from -span to span; no rows without values."""
    z = (F.col("value") - mean) / sd
    step = 2 * span / (points - 1)
    at = F.greatest(F.ceil((z + span) / step), F.lit(0)).cast("int").alias("i")
    n = values.select("value").where("value is not null").groupBy(at).agg(F.count("*").alias("n"))
    full = values.sparkSession.range(points).select(F.col("id").cast("int").alias("i")).join(n, "i", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    one = Window.partitionBy(F.lit(0))
    upto, total = F.sum("n").over(one.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(one)
    grid = F.col("i") * step - span
    half = F.sqrt(-F.ln(F.lit(alpha / 2)) / 2) / F.sqrt("total")
    counted = full.withColumns({"upto": upto, "total": total}).where("total > 0")
    return counted.select("i", grid.alias("z"), (F.col("upto") / F.col("total")).alias("ecdf"), norm_cdf(grid).alias("normal"), half.alias("band")).where(F.col("i") < points)


def roc(scores: DataFrame, thresholds: int = 501) -> DataFrame:
    """(i, threshold, fpr, tpr): shares of negatives and positives with a score strictly below each threshold of [0, 1].

    scores: score, positive. Scores fall into the threshold's bucket, and counts run over the buckets.
    """
    steps = thresholds - 1
    at = (F.floor(F.col("score") * steps) + 1).cast("int").alias("i")
    n = scores.where("score is not null and positive is not null").groupBy(at).agg(F.count_if(F.col("positive")).alias("p"), F.count_if(~F.col("positive")).alias("q"))
    full = scores.sparkSession.range(thresholds).select(F.col("id").cast("int").alias("i")).join(n, "i", "full").fillna(0, ["p", "q"])
    one = Window.partitionBy(F.lit(0))
    upto = one.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("i", (F.col("i") / steps).alias("threshold"), (F.sum("q").over(upto) / F.sum("q").over(one)).alias("fpr"), (F.sum("p").over(upto) / F.sum("p").over(one)).alias("tpr")).where(F.col("i") < thresholds)
