"""Distribution losses as aggregates over columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.functions import vectors as V
from loadweave.operators.ordering import running_counts

KERNEL_WIDTHS = (10.0, 15.0, 20.0, 50.0)  # fixed values: widths of the four kernels


def _mean_loss(df: DataFrame, pred: str, real: str, loss, weight: str | None) -> Column:
    per_row = F.aggregate(F.zip_with(V.as_double(F.col(pred)), V.as_double(F.col(real)), loss), F.lit(0.0), lambda s, x: s + x)
    size = F.size(pred)
    if weight is None:
        return F.try_divide(F.sum(per_row), F.sum(size))
    w = F.col(weight).cast("double")
    return F.try_divide(F.sum(per_row * w), F.sum(w * size))


def quantile_loss(df: DataFrame, pred: str, real: str, q: float, weight: str | None = None) -> Column:
    """Mean of max(q (r - p), (1 - q) (p - r)) over all elements; rows count by weight."""
    return _mean_loss(df, pred, real, lambda p, r: F.greatest(F.lit(q) * (r - p), F.lit(1 - q) * (p - r)), weight)


def mse_loss(df: DataFrame, pred: str, real: str, weight: str | None = None) -> Column:
    return _mean_loss(df, pred, real, lambda p, r: (p - r) * (p - r), weight)


def bce_on_logits(z: Column, y: Column) -> Column:
    """Mean binary cross-entropy, stable for large logits."""
    return F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * y)


def mmd(df: DataFrame, batch: str, side: str, vector: str, key: str, weight: str | None = None) -> DataFrame:
    """Maximum mean discrepancy per batch between side = 0 and side = 1, four Gaussian kernels; batch, mmd.

    The pairs of a batch are formed by an equi-join on the batch, so the batch size bounds the work; both sides of a
    batch must have as many rows, else the batch gives null. With weights a pair counts w_i * w_j.
    """
    one = df.select(F.col(batch).alias("_b"), F.col(key).alias("_k"), F.col(side).alias("_s"), V.as_double(F.col(vector)).alias("_v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    two = one.toDF("_b", "_k2", "_s2", "_v2", "_w2")
    d2 = V.squared_distance(F.col("_v"), F.col("_v2"))
    # the kernel is symmetric: each unordered pair is computed once and counted twice
    twice = F.when(F.col("_k") == F.col("_k2"), 1.0).otherwise(2.0)
    pairs = one.join(two, "_b").where(F.col("_k") <= F.col("_k2")).withColumn("_d2", d2)
    kernel = sum((F.exp(-F.col("_d2") / (2 * a)) for a in KERNEL_WIDTHS[1:]), F.exp(-F.col("_d2") / (2 * KERNEL_WIDTHS[0])))
    sign = F.when(F.col("_s") == F.col("_s2"), 1.0).otherwise(-1.0)
    total = pairs.groupBy("_b").agg(F.sum(kernel * sign * twice * F.col("_w") * F.col("_w2")).alias("_t"))
    counts = one.groupBy("_b").agg(F.sum(F.when(F.col("_s") == 0, 1).otherwise(0)).alias("_n0"), F.sum(F.when(F.col("_s") == 1, 1).otherwise(0)).alias("_n1"), F.sum(F.when(F.col("_s") == 0, F.col("_w"))).alias("_w0"))
    return total.join(counts, "_b").select(F.col("_b").alias(batch), F.when(F.col("_n0") == F.col("_n1"), F.try_divide("_t", F.col("_w0") * F.col("_w0"))).alias("mmd"))


def training_loss(pairs: DataFrame, pred: str, real: str, mmd_value: Column, weights: tuple[float, float, float, float] = (2.0, 4.0, 1.0, 4.0), weight: str | None = None) -> DataFrame:
    """One row: total, mmd, mse, quantile. total = mmd + a mse + b pinball(.95) + c pinball(.05) + d pinball(.5)."""
    a, b, c, d = weights
    parts = pairs.agg(
        F.max(mmd_value).alias("mmd"),
        (F.lit(a) * mse_loss(pairs, pred, real, weight)).alias("mse"),
        (F.lit(b) * quantile_loss(pairs, pred, real, 0.95, weight) + F.lit(c) * quantile_loss(pairs, pred, real, 0.05, weight) + F.lit(d) * quantile_loss(pairs, pred, real, 0.5, weight)).alias("quantile"),
    )
    return parts.select((F.col("mmd") + F.col("mse") + F.col("quantile")).alias("total"), "mmd", "mse", "quantile")


def profile_stats(df: DataFrame, vector: str, group: str) -> DataFrame:
    """Mean, median and 95th percentile per group and slot, linear interpolation; exact, from counts of distinct values that are summed up to each."""
    long = df.select(group, F.posexplode(V.as_double(F.col(vector))).alias("pos", "x")).where("x is not null")
    counts = long.groupBy(F.struct(group, "pos").alias("_g"), "x").agg(F.count("*").alias("c"))
    sizes = counts.groupBy(F.col("_g").alias("_of")).agg(F.sum("c").alias("n"))
    h = running_counts(counts, "_g", "x", "c").join(sizes, F.col("_g").eqNullSafe(F.col("_of")))

    def at(rank: Column) -> Column:
        """The value of a rank counted from 0."""
        return F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("x")))

    def percentile(q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        low = F.floor(place)
        a, b, share = at(low), at(F.least(low + 1, F.col("n") - 1)), F.max(place - low)
        return (1 - share) * a + share * b

    out = h.groupBy("_g").agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"), percentile(0.5).alias("median"), percentile(0.95).alias("p95"))
    return out.select(F.col(f"_g.{group}").alias(group), F.col("_g.pos").alias("pos"), "mean", "median", "p95")
