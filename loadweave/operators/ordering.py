"""Global ranks, exact samples, shuffles and batches without a single-task window.

An order is cut into buckets; counts per bucket are prefix-summed over the bounded number of buckets and a row's rank
is the count before its bucket plus its place inside. Hash orders are cut by hex prefix, value orders by quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 0) -> Column:
    """32 hex digits that depend on key and seed only: the same in every engine and for every partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def _ranked(df: DataFrame, bucket: str, order: list[Column], out: str) -> DataFrame:
    counts = df.groupBy(bucket).agg(F.count("*").alias("_lw_c"))
    before = counts.withColumn("_lw_before", F.sum("_lw_c").over(Window.orderBy(bucket)) - F.col("_lw_c")).drop("_lw_c")
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    # one row per bucket, and buckets are bounded by construction
    return df.withColumn("_lw_in", inside).join(F.broadcast(before), bucket).withColumn(out, (F.col("_lw_before") + F.col("_lw_in")).cast("long")).drop("_lw_in", "_lw_before", bucket)


def shuffle_positions(df: DataFrame, key: str, seed: int = 0, out: str = "pos", prefix: int = 3) -> DataFrame:
    """A position from 1 in hash order of the key; 16**prefix buckets."""
    h = df.withColumn("_lw_h", hash_order(F.col(key), seed)).withColumn("_lw_b", F.substring("_lw_h", 1, prefix))
    return _ranked(h, "_lw_b", [F.col("_lw_h"), F.col(key)], out).drop("_lw_h")


def _cuts(df: DataFrame, column: str, buckets: int) -> list[float]:
    """At most `buckets` - 1 quantiles of a numeric column, repeated where one value fills several buckets."""
    return sorted(df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or [])


def _table(cuts: list[float]) -> Column:
    return F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")


def value_ranks(df: DataFrame, value: str, tie: str, out: str = "rank", buckets: int = 256) -> DataFrame:
    """A rank from 1 by falling value, ties by `tie`; nulls last.

    Rows of a value that fills whole buckets, and rows without value, are cut further by quantiles of a numeric tie.
    """
    cuts = _cuts(df, value, buckets)
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    bucket = F.when(F.col(value).isNull(), F.lit(buckets + 1)).otherwise(F.size(F.filter(_table(sorted(set(cuts))), lambda c: c > F.col(value))))
    if dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        ties = _table(sorted(set(_cuts(df, tie, buckets))))
        # a bucket's other values are greater than its hot one, so they come before all of its parts
        part = 1 + F.size(F.filter(ties, lambda c: c <= F.col(tie)))
        bucket = bucket * (buckets + 2) + F.when(F.col(value).isNull() | F.col(value).isin(hot), F.coalesce(part, F.lit(0))).otherwise(0)
    return _ranked(df.withColumn("_lw_b", bucket), "_lw_b", [F.col(value).desc_nulls_last(), F.col(tie)], out)


def key_positions(df: DataFrame, key: str, out: str = "pos", buckets: int = 256) -> DataFrame:
    """A position from 1 by rising numeric key."""
    bucket = F.size(F.filter(_table(sorted(set(_cuts(df, key, buckets)))), lambda c: c <= F.col(key)))
    return _ranked(df.withColumn("_lw_b", F.coalesce(bucket, F.lit(-1))), "_lw_b", [F.col(key)], out)


def running_counts(df: DataFrame, group: str, value: str, count: str, out: str = "upto", buckets: int = 64) -> DataFrame:
    """Adds, per group, the sum of `count` over all rows with a value up to the row's; one row per group and value.

    Values are cut at quantiles of their group, so no task holds a group. The joins carry no hints: the tables of cuts and
    of bucket sums have a row per group and per group and bucket, which AQE broadcasts where they are small.
    """
    cuts = df.groupBy(F.col(group).alias("_lw_g")).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_lw_cuts"))
    cut = df.join(cuts, F.col(group).eqNullSafe(F.col("_lw_g"))).drop("_lw_g").withColumn("_lw_b", F.size(F.filter("_lw_cuts", lambda c: c < F.col(value)))).drop("_lw_cuts")
    sums = cut.groupBy(F.col(group).alias("_lw_g"), F.col("_lw_b").alias("_lw_bb")).agg(F.sum(count).alias("_lw_s"))
    before = sums.select("_lw_g", "_lw_bb", (F.sum("_lw_s").over(Window.partitionBy("_lw_g").orderBy("_lw_bb")) - F.col("_lw_s")).alias("_lw_before"))
    inside = F.sum(count).over(Window.partitionBy(group, "_lw_b").orderBy(value))
    ranked = cut.withColumn("_lw_in", inside).join(before, F.col(group).eqNullSafe(F.col("_lw_g")) & (F.col("_lw_b") == F.col("_lw_bb")))
    return ranked.withColumn(out, F.col("_lw_before") + F.col("_lw_in")).drop("_lw_g", "_lw_bb", "_lw_b", "_lw_before", "_lw_in")


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the first in hash order."""
    return shuffle_positions(df, key, seed, "_lw_pos").where(F.col("_lw_pos") <= n).drop("_lw_pos")


def batches(df: DataFrame, key: str, size: int, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """Adds pos and batch_id; with drop_last the last batch goes if it is not full."""
    out = shuffle_positions(df, key, seed).withColumn("batch_id", F.floor((F.col("pos") - 1) / size).cast("long"))
    if drop_last:
        out = out.where(F.col("batch_id") < df.count() // size)
    return out


def first_batch(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows in shuffled order; asking for more rows than there are raises."""
    rows = df.count()
    if n > rows:
        raise ValueError(f"{n} rows wanted, {rows} there")
    return exact_sample(df, key, n, seed)


def train_eval_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 100) -> DataFrame:
    """Adds part: 'train' for the first floor(train * n) rows in hash order, else 'eval'."""
    most = int(train * df.count())
    return shuffle_positions(df, key, seed, "_lw_pos").withColumn("part", F.when(F.col("_lw_pos") <= most, "train").otherwise("eval")).drop("_lw_pos")


def expand_by_weight(df: DataFrame, weight: str, out: str = "copy") -> DataFrame:
    """Each row `weight` times, numbered from 1; a weight of 0, below 0 or null drops the row."""
    w = F.col(weight).cast("int")
    return df.where(w > 0).withColumn(out, F.explode(F.sequence(F.lit(1), w)))


def household_groups(ids: DataFrame, id_col: str, n: int, seed: int = 0, disjoint: bool = False) -> DataFrame:
    """Train: the first n ids in hash order, holdout: the last n; with fewer than 2n ids the groups overlap unless disjoint."""
    distinct = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    total = distinct.count()
    ranked = shuffle_positions(distinct, id_col, seed)
    low = max(total - n, n if disjoint else 0)
    groups = F.array_compact(F.array(F.when(F.col("pos") <= n, "train"), F.when(F.col("pos") > low, "holdout")))
    return ranked.select(id_col, F.explode(groups).alias("household_group"))
