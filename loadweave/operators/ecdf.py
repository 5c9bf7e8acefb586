"""Empirical distribution functions per slot and quantile mapping. Ranks are integers, so no rounding can lose one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.operators.ordering import running_counts


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, x) of the non-null elements."""
    return df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).where("x is not null")


def fit(long: DataFrame, key: str) -> DataFrame:
    """(pos, k, x, n): the k-th order statistic of each slot. Fitting again on a union continues the estimate."""
    h = histogram(long)
    return h.select("pos", F.explode(F.sequence((F.col("upto") - F.col("c") + 1).cast("int"), F.col("upto").cast("int"))).alias("k"), "x", "n")


def histogram(long: DataFrame) -> DataFrame:
    """(pos, x, c, upto, n): the distinct values of each slot, how often each comes, how many are at or below, how many there are.

    Counted with map-side combine before anything is sorted, so a frequent value is one row.
    """
    h = long.groupBy("pos", "x").agg(F.count("*").alias("c"))
    sizes = h.groupBy(F.col("pos").alias("_p")).agg(F.sum("c").alias("n"))
    return running_counts(h, "pos", "x", "c").join(sizes, F.col("pos") == F.col("_p")).select("pos", "x", "c", "upto", "n")


def cdf(fitted: DataFrame) -> DataFrame:
    """(pos, x, cdf) at the distinct values of each slot."""
    return fitted.groupBy("pos", "x").agg((F.max("k") / F.max("n")).alias("cdf"))


def transform(fitted: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(key, pos, p): the share of fitted values at or below each query value. Each distinct query value is placed once."""
    known = fitted.groupBy("pos", "x").agg(F.count("*").alias("c"))
    asked = queries.select("pos", "x").distinct()
    sizes = known.groupBy(F.col("pos").alias("_p")).agg(F.sum("c").alias("n"))
    both = known.unionByName(asked.withColumn("c", F.lit(0).cast("long"))).groupBy("pos", "x").agg(F.sum("c").alias("c"))
    at = running_counts(both, "pos", "x", "c", "below").join(sizes, F.col("pos") == F.col("_p"), "left").select("pos", "x", F.try_divide("below", F.coalesce("n", F.lit(0))).alias("p"))
    return queries.join(at, ["pos", "x"]).select(key, "pos", "p")


def inverse(fitted: DataFrame, probabilities: DataFrame, key: str) -> DataFrame:
    """(key, pos, x): the order statistic at floor(p n), clamped to 1..n."""
    sizes = fitted.groupBy("pos").agg(F.max("n").alias("n"))
    want = probabilities.join(sizes, "pos").withColumn("k", F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("p") * F.col("n")))).cast("int"))
    return want.select(key, "pos", "k").join(fitted.select("pos", "k", "x"), ["pos", "k"]).select(key, "pos", "x")


def calibrate(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, pos, x, calibrated): source values moved to the target's marginals; rank r of n_s maps to rank r n_t div n_s."""
    t = fit(target, key).select("pos", F.col("k").alias("_kt"), F.col("x").alias("calibrated"), F.col("n").alias("_nt"))
    s = histogram(source).select("pos", "x", F.col("upto").alias("_r"), F.col("n").alias("_ns"))
    sizes = t.groupBy("pos").agg(F.max("_nt").alias("_n"))
    s = s.join(sizes, "pos").withColumn("_kt", F.expr("greatest(1, least(_n, _r * _n div _ns))").cast("int"))
    moved = s.join(t.select("pos", "_kt", "calibrated"), ["pos", "_kt"]).select("pos", "x", "calibrated")
    return source.join(moved, ["pos", "x"]).select(key, "pos", "x", "calibrated")
