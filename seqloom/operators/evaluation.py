"""Scores against ratings: means, last value, defaults, Kendall's tau-b and Pearson's r."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.linear import two_sided_normal, two_sided_student
from seqloom.sources import stage


def group_mean(ratings: DataFrame, by: list[str], value: str) -> DataFrame:
    return ratings.groupBy(*by).agg(F.avg(value).alias("mean"))


def kind_means(ratings: DataFrame, kind: str, of: str, by: str, value: str) -> DataFrame:
    """by, mean of the rows of one kind, as of the onsets that are not attested."""
    return group_mean(ratings.filter(F.col(kind) == of), [by], value)


def merged(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The rows of both tables that share a key; columns of one name but the key are told apart by _x and _y."""
    both = [c for c in left.columns if c in right.columns and c != on]
    return left.withColumnsRenamed({c: f"{c}_x" for c in both}).join(right.withColumnsRenamed({c: f"{c}_y" for c in both}), on)


def last_value(scores: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The value of the last row of each key."""
    return scores.groupBy(*by).agg(F.max_by(value, order).alias("last"))


def with_default(left: DataFrame, scores: DataFrame, on: str, value: str, default: float = 0.0) -> DataFrame:
    """All keys of `left`, those without a score with the default."""
    return left.join(scores, on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def looked_up(rows: DataFrame, keys: str, values: dict[str, float], to: str) -> DataFrame:
    """Values of an array's symbols from a small table, null where there is none."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return rows.withColumn(to, F.transform(keys, lambda k: F.try_element_at(pairs, k)))


def long_form(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each value column: keys, measure, value."""
    return table.unpivot(keys, values, "measure", "value")


def combined_p(rows: DataFrame, by: list[str], p: str) -> DataFrame:
    """by, k (values), fisher (the chi-square tail of -2 sum ln p with 2 k degrees of freedom), harmonic (mean p), of p-values above 0 that aren't null.

    With an even number of degrees of freedom the tail is a finite sum, taken over logarithms so that no term underflows by itself.
    """
    one = rows.filter(F.col(p) > 0).groupBy(*by).agg(F.count("*").alias("k"), (-F.sum(F.ln(p))).alias("h"), F.sum(1 / F.col(p)).alias("inverse"))
    ln_h = F.ln("h")
    step = lambda s, i: F.struct((s["term"] + ln_h - F.ln(i.cast("double"))).alias("term"), (s["total"] + F.exp(s["term"] + ln_h - F.ln(i.cast("double")))).alias("total"))
    start = F.struct((-F.col("h")).alias("term"), F.exp(-F.col("h")).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("k") - 1), start, step, lambda s: s["total"])
    fisher = F.when(F.col("h") <= 0, 1.0).when(F.col("k") == 1, F.exp(-F.col("h"))).otherwise(F.least(tail, F.lit(1.0)))
    return one.select(*by, "k", fisher.alias("fisher"), (F.col("k") / F.col("inverse")).alias("harmonic"))


def agreement(ratings: DataFrame, scores: DataFrame, onset: str, attested: str, kind: str, rating: str, score: str, order: str) -> DataFrame:
    """One row, tau, r and their p-values, of the mean ratings of the onsets of one kind of attestedness and their last scores (0 without one)."""
    means = group_mean(ratings.filter(F.col(attested) == kind), [onset], rating)
    both = with_default(means, last_value(scores, [onset], order, score).withColumnRenamed("last", "score"), onset, "score")
    tau = with_p_values(kendall(both, F.col("mean"), F.col("score"))).select("tau", F.col("p").alias("tau_p"))
    r = with_p_values(pearson(both, "mean", "score")).select("r", F.col("p").alias("r_p"))
    return tau.join(F.broadcast(r))  # single rows


def ranked(values: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """`name`, rank (dense, from 0) of the distinct values: sorted by ranges, numbered in each range and shifted by the ranges before it."""
    parts = parts or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(values.select(name).distinct().repartitionByRange(parts, name).select(name, F.spark_partition_id().alias("part")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(sizes.select("part", before.alias("shift")))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    return rows.withColumn("own", own).join(shift, "part").select(name, (F.col("own") + F.col("shift")).alias("rank"))


def kendall(pairs: DataFrame, x: Column, y: Column, block: int = 1024) -> DataFrame:
    """One row: tau (tau-b), z (its normal score, ties corrected) and n.

    Pairs of rows are never formed. Two values of x part at the highest bit in which their ranks differ: for each bit, the rows
    that agree above it are summed by y on both sides of it, and running sums over y, in blocks of ranks, count what lies below and above.
    """
    cells = stage(pairs.select(x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("n")))
    xs = stage(ranked(cells, "x").withColumnRenamed("rank", "xr"))
    rows = cells.join(xs, "x").join(ranked(cells, "y").withColumnRenamed("rank", "yr"), "y").select("xr", "yr", "n")
    bits = max(1, int(xs.agg(F.coalesce(F.max("xr"), F.lit(0))).first()[0]).bit_length())
    rows = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    right = F.pmod(F.expr("shiftright(xr, bit)"), F.lit(2)) == 1
    sides = rows.groupBy("bit", F.expr("shiftright(xr, bit + 1)").alias("above"), "yr").agg(F.coalesce(F.sum(F.when(~right, F.col("n"))), F.lit(0)).alias("left"), F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)).alias("right"))
    sides = stage(sides.withColumn("block", F.floor(F.col("yr") / block)))
    group = Window.partitionBy("bit", "above")
    earlier = Window.unboundedPreceding, -1
    blocks = sides.groupBy("bit", "above", "block").agg(F.sum("left").alias("size"))
    blocks = blocks.select("bit", "above", "block", F.coalesce(F.sum("size").over(group.orderBy("block").rowsBetween(*earlier)), F.lit(0)).alias("shift"), F.sum("size").over(group).alias("all_left"))
    inside = F.coalesce(F.sum("left").over(Window.partitionBy("bit", "above", "block").orderBy("yr").rowsBetween(*earlier)), F.lit(0))
    both = sides.withColumn("inside", inside).filter("right > 0").join(blocks, ["bit", "above", "block"])
    lower = F.col("inside") + F.col("shift")
    score = both.agg(F.coalesce(F.sum(F.col("right").cast("double") * (2 * lower + F.col("left") - F.col("all_left"))), F.lit(0.0)).alias("s"))

    def ties(c: str) -> DataFrame:
        t = F.col("t").cast("double")
        sums = {f"one_{c}": t * (t - 1) / 2, f"two_{c}": t * (t - 1) * (t - 2), f"three_{c}": t * (t - 1) * (2 * t + 5)}
        return cells.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(t).alias(f"n_{c}"), *[F.sum(v).alias(k) for k, v in sums.items()])

    one = score.join(F.broadcast(ties("x"))).join(F.broadcast(ties("y")))  # single rows
    n, pair = F.col("n_x"), F.col("n_x") * (F.col("n_x") - 1)
    tau = F.try_divide(F.col("s"), F.sqrt((pair / 2 - F.col("one_x")) * (pair / 2 - F.col("one_y"))))
    spread = (pair * (2 * n + 5) - F.col("three_x") - F.col("three_y")) / 18 + F.try_divide(2 * F.col("one_x") * F.col("one_y"), pair) + F.coalesce(F.try_divide(F.col("two_x") * F.col("two_y"), 9 * pair * (n - 2)), F.lit(0.0))
    return one.select(tau.alias("tau"), F.try_divide(F.col("s"), F.sqrt(spread)).alias("z"), n.cast("long").alias("n"))


def pearson(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row: r, t (its Student score) and n."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    one = pairs.filter(a.isNotNull() & b.isNotNull()).agg(F.corr(a, b).alias("r"), F.count("*").alias("n"))
    return one.select("r", F.try_divide(F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)).cast("double")), F.sqrt(1 - F.col("r") * F.col("r"))).alias("t"), "n")


def with_p_values(scores: DataFrame) -> DataFrame:
    """The few rows of kendall() or pearson() and p, two-sided: of the normal score z, or of the Student score t with n - 2 degrees of freedom."""
    by_z = "z" in scores.columns

    @F.pandas_udf("double")
    def p(score: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else two_sided_normal(v) if by_z else two_sided_student(v, int(k) - 2) for v, k in zip(score, n)], dtype="float64")

    return scores.withColumn("p", p(F.col("z" if by_z else "t"), F.col("n")))
