"""Problem 6: implausible spikes, stuck values and impossible readings, judged per household.

Per household a generalised Pareto tail is fitted to the residuals over its day-part level (peaks over threshold),
which gives a cutoff at a fixed risk. Readings beyond it are tail peaks, and only they can be spikes: of them those
beyond `level_factor` times the household's percentile are. Runs of one value, and values no house supply can have,
are added by rule.

What the fit needs comes from aggregates with map-side combine, never from a window over readings: sums per day part
with a coarse value histogram, then a histogram of residuals with its moments, both bounded per household whatever its
rows, and the single values of the one or two value bins in which the percentile lies, so that it is exact. Readings
are shuffled once, for the runs, by household (heavy households by household and time bucket, cut at quantiles of
time; runs that cross a cut are stitched through their edge fragments, at most two per bucket). No limit and no flag
depends on how households are split.

Defined results: rows without a number are never flagged; rows without time take no part in runs; rows without any
household are judged as one group. Ties in time: the newest (ingested_at, then reading_id) makes the run, an older
one of the same value is flagged with it. Where too few peaks or no spread allow a fit, the threshold itself is the
cutoff. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.functions import readings as R
from loadweave.session import stage_table
from loadweave.skew import heavy_keys

DAY_PARTS = 8
#: widths of the value and the residual histogram, in kWh
VALUE_BIN, RESIDUAL_BIN = 0.1, 0.02


def _day_part() -> Column:
    return F.coalesce(F.pmod(F.floor(F.col("_ts") / (86400 // DAY_PARTS)), F.lit(DAY_PARTS)).cast("int"), F.lit(0))


def _season(fit: Column) -> Column:
    """Level of the reading's day part without the reading itself, drawn towards the household's level in thin parts."""
    own = F.when(fit, F.col("_kwh")).otherwise(0.0)
    return (F.get("_s", F.col("_part")) - own + 4 * F.col("_mean")) / (F.get("_c", F.col("_part")) - F.when(fit, 1).otherwise(0) + 4)


def household_limits(rows: DataFrame, lowest: float, highest: float, percentile: float, tail: float, risk: float, least_peaks: int) -> DataFrame:
    """_hh, _all (its rows), _level (the percentile), _s and _c (sums and counts by day part), _mean, _cut (residual cutoff): one row per household.

    rows: _hh, _ts, _kwh.
    """
    fit = F.col("_kwh").between(lowest, highest)
    top = int((highest - lowest) / VALUE_BIN) + 1
    rows = rows.withColumn("_part", _day_part()).withColumn("_bin", F.when(F.col("_kwh") < lowest, -1).when(fit, F.floor((F.col("_kwh") - lowest) / VALUE_BIN).cast("int")).otherwise(top))
    coarse = rows.groupBy("_hh", "_part", "_bin").agg(F.count("*").alias("_n"), F.sum(F.when(fit, F.col("_kwh"))).alias("_sum"))
    # _lo and _hi are the ranks (from 0) between which the percentile lies
    coarse = coarse.selectExpr(
        "*",
        "sum(_n) OVER (PARTITION BY _hh ORDER BY _bin RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _upto",
        "coalesce(sum(_n) OVER (PARTITION BY _hh ORDER BY _bin RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _below",
        "sum(_n) OVER (PARTITION BY _hh) AS _all",
    ).selectExpr("*", f"CAST(floor({percentile!r}D * (_all - 1)) AS BIGINT) AS _lo").selectExpr("*", "least(_lo + 1, _all - 1) AS _hi")
    known = F.col("_bin").between(0, top - 1)
    per = coarse.groupBy("_hh").agg(
        F.max("_all").alias("_all"),
        F.max("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.min(F.expr("CASE WHEN _below <= _lo AND _lo < _upto THEN _below END")).alias("_below"),
        F.min(F.expr("CASE WHEN _below <= _lo AND _lo < _upto THEN _bin END")).alias("_bin_lo"),
        F.min(F.expr("CASE WHEN _below <= _hi AND _hi < _upto THEN _bin END")).alias("_bin_hi"),
        F.array(*[F.coalesce(F.sum(F.when(known & (F.col("_part") == i), F.col("_sum"))), F.lit(0.0)) for i in range(DAY_PARTS)]).alias("_s"),
        F.array(*[F.coalesce(F.sum(F.when(known & (F.col("_part") == i), F.col("_n"))), F.lit(0)) for i in range(DAY_PARTS)]).alias("_c"),
        F.coalesce(F.try_divide(F.sum(F.when(known, F.col("_sum"))), F.sum(F.when(known, F.col("_n")))), F.lit(0.0)).alias("_mean"),
    )
    per = stage_table(per, "households")

    # a histogram of the residuals, and the single values of the bins that hold the percentile
    e = with_limits(rows.where(fit), per.select("_hh", "_s", "_c", "_mean")).select("_hh", (F.col("_kwh") - _season(fit)).alias("x"))
    e = e.select("_hh", F.floor(F.col("x") / RESIDUAL_BIN).alias("key"), "x").groupBy("_hh", "key").agg(F.count("*").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    v = with_limits(rows, per.select("_hh", "_bin_lo", "_bin_hi")).where("_bin between _bin_lo and _bin_hi").groupBy("_hh", F.col("_kwh").alias("key")).agg(F.count("*").alias("n"))
    fine = e.select("_hh", F.lit("e").alias("k"), F.col("key").cast("double").alias("key"), "n", "s1", "s2").unionByName(v.select("_hh", F.lit("v").alias("k"), "key", "n"), allowMissingColumns=True)
    fine = fine.join(per.select("_hh", "_all", "_lo", "_hi", "_below"), "_hh")
    fine = fine.selectExpr("*", "sum(n) OVER (PARTITION BY _hh, k ORDER BY key) AS _upto", "sum(n) OVER (PARTITION BY _hh, k) AS _total")
    fine = fine.selectExpr("*", f"max(CASE WHEN k = 'e' AND _upto - n < {tail!r}D * _total AND _upto >= {tail!r}D * _total THEN key END) OVER (PARTITION BY _hh, k) AS _ub")
    fine = fine.withColumn("_u", (F.col("_ub") + 1) * RESIDUAL_BIN)
    found = fine.groupBy("_hh").agg(
        F.max("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.max("_all").alias("_all"),
        F.max(F.expr("CASE WHEN k = 'v' AND _below + _upto - n <= _lo AND _lo < _below + _upto THEN key END")).alias("_v_lo"),
        F.max(F.expr("CASE WHEN k = 'v' AND _below + _upto - n <= _hi AND _hi < _below + _upto THEN key END")).alias("_v_hi"),
        F.max("_u").alias("_u"),
        F.max(F.expr("CASE WHEN k = 'e' THEN _total END")).alias("_n"),
        F.sum(F.expr("CASE WHEN key > _ub THEN n ELSE 0 END")).alias("_nx"),
        F.sum(F.expr("CASE WHEN key > _ub THEN s1 - _u * n ELSE 0D END")).alias("_x1"),
        F.sum(F.expr("CASE WHEN key > _ub THEN s2 - 2D * _u * s1 + _u * _u * n ELSE 0D END")).alias("_x2"),
    )
    found = found.selectExpr(
        "*",
        f"({percentile!r}D * (_all - 1)) AS _pos",
        "try_divide(_x1, _nx) AS _m",
        "try_divide(_x2 - try_divide(_x1 * _x1, _nx), _nx - 1) AS _v",
        "try_divide(_nx, _n) AS _zeta",
    ).selectExpr("*", "CASE WHEN _v > 0 THEN _m * _m / _v END AS _q")
    # method-of-moments tail
    found = found.selectExpr("*", "0.5D * (1D - _q) AS _xi", "0.5D * _m * (_q + 1D) AS _sigma")
    tailed = (
        f"CASE WHEN _nx < {least_peaks} OR _xi IS NULL OR _zeta <= {risk!r}D THEN _u "
        f"WHEN abs(_xi) < 1e-6 THEN _u + _sigma * ln(_zeta / {risk!r}D) "
        f"ELSE _u + _sigma / _xi * (pow({risk!r}D / _zeta, -_xi) - 1D) END"
    )
    found = found.selectExpr("_hh", "_all", "CASE WHEN _lo = _hi THEN _v_lo ELSE (_hi - _pos) * _v_lo + (_pos - _lo) * _v_hi END AS _level", f"coalesce({tailed}, _u) AS _cut")
    return found.join(per.select("_hh", "_s", "_c", "_mean"), "_hh")


def with_limits(rows: DataFrame, limits: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """Left-join a staged table of one row per household; up to `broadcast_rows` counted rows are broadcast."""
    return rows.join(F.broadcast(limits) if limits.count() <= broadcast_rows else limits, "_hh", "left")


def flag_spikes(
    readings: DataFrame,
    lowest: float = 0.0,
    highest: float = 11.5,
    percentile: float = 0.95,
    level_factor: float = 4.0,
    run_length: int = 12,
    tail: float = 0.95,
    risk: float = 0.04,
    least_peaks: int = 10,
    heavy_share: float = 1 / 64,
    heavy_rows: int = 50_000,
    bucket_rows: int = 200_000,
    max_cuts: int = 255,
    peaks: bool = False,
) -> DataFrame:
    """Flagged readings only: reading_id, household, kwh_value, level (the percentile), tail_cutoff, reasons.

    With peaks also readings that are only beyond their tail cutoff, and 'tail' among the reasons of all that are.
    """
    rows = R.with_household(readings.select("LCLid", "source_file", "DateTime", "kwh", "ingested_at", "reading_id"), "_hh", R.learn_files(readings))
    rows = rows.select("reading_id", F.coalesce("_hh", F.lit("")).alias("_hh"), R.epoch_seconds(F.col("DateTime")).alias("_ts"), R.number(F.col("kwh")).alias("_kwh"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("_ing"))
    rows = stage_table(rows.where("_kwh is not null"), "spikes")
    limits = stage_table(household_limits(rows, lowest, highest, percentile, tail, risk, least_peaks), "limits")
    counts = limits.select("_hh", F.col("_all").alias("_lw_n"))
    heavy = heavy_keys(rows, "_hh", "_ts", rows.count(), share=heavy_share, bucket_rows=bucket_rows, least_rows=heavy_rows, max_cuts=max_cuts, counts=counts)
    limits = limits.drop("_all")

    fit = F.col("_kwh").between(lowest, highest)
    rows = with_limits(rows, limits).withColumn("_part", _day_part())
    rows = rows.withColumn("_b", heavy.bucket(F.col("_hh"), F.col("_ts"))).withColumn("_limit", _season(fit) + F.col("_cut"))
    rows = rows.withColumn("_peak", F.coalesce(fit & (F.col("_kwh") > F.col("_limit")), F.lit(False)))
    # a value beyond the plausible range is beyond any cutoff
    rows = rows.withColumn("_spike", F.coalesce((F.col("_peak") | (F.col("_kwh") > highest)) & (F.col("_kwh") > level_factor * F.col("_level")), F.lit(False)))
    rows = rows.select("reading_id", "_hh", "_b", "_ts", "_kwh", "_ing", "_level", "_limit", (~fit).alias("_bad"), "_spike", (F.col("_peak") if peaks else F.lit(False)).alias("_peak"))

    spec = "PARTITION BY _hh, _b ORDER BY _ts ASC NULLS FIRST, _ing DESC NULLS LAST, reading_id DESC"
    past = f"OVER ({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    upto = f"OVER ({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = rows.selectExpr("*", f"lag(_ts) OVER ({spec}) AS _ts_before")
    rows = rows.selectExpr("*", "_ts IS NOT NULL AND (_ts_before IS NULL OR _ts_before <> _ts) AS _newest")
    rows = rows.selectExpr("*", f"last(CASE WHEN _newest THEN _kwh END, true) {past} AS _kwh_before")
    rows = rows.selectExpr("*", "_newest AND (_kwh_before IS NULL OR _kwh_before <> _kwh) AS _start")
    rows = rows.selectExpr(
        "*",
        f"sum(CASE WHEN _start THEN 1 ELSE 0 END) {upto} AS _run",
        f"lead(_start) OVER ({spec}) AS _start_after",
    )
    # the newest row of an instant comes first, so for the older ones it is the last newest before
    rows = rows.selectExpr("*", "CASE WHEN _newest THEN _kwh ELSE _kwh_before END AS _run_kwh")
    rows = rows.selectExpr("*", "_ts IS NOT NULL AND _kwh > 0 AND coalesce(_kwh = _run_kwh, false) AS _may")
    is_heavy = heavy.is_heavy(F.col("_hh"))
    kept = rows.where(F.col("_bad") | F.col("_spike") | F.col("_peak") | (F.col("_may") & (~F.col("_start") | ~F.coalesce("_start_after", F.lit(True)))) | is_heavy)
    kept = kept.select("reading_id", "_hh", "_b", "_kwh", "_level", "_limit", "_bad", "_spike", "_peak", "_may", "_newest", "_run")
    per_run = Window.partitionBy("_hh", "_b", "_run")
    kept = kept.withColumn("_len", F.sum(F.when(F.col("_newest"), 1).otherwise(0)).over(per_run))

    if heavy.bounds:
        hot = rows.where(is_heavy & (F.col("_run") > 0))
        pieces = hot.groupBy("_hh", "_b", "_run").agg(F.sum(F.when(F.col("_newest"), 1).otherwise(0)).alias("_c"), F.max("_run_kwh").alias("_rv"))
        edge = pieces.withColumn("_last", F.max("_run").over(Window.partitionBy("_hh", "_b"))).where("_run = 1 OR _run = _last")
        by_time = Window.partitionBy("_hh").orderBy("_b", "_run")
        edge = edge.withColumn("_fresh", F.when((F.col("_run") == 1) & (F.lag("_rv").over(by_time) == F.col("_rv")), 0).otherwise(1))
        edge = edge.withColumn("_chain", F.sum("_fresh").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        edge = edge.withColumn("_total", F.sum("_c").over(Window.partitionBy("_hh", "_chain"))).select("_hh", "_b", "_run", "_total")
        # at most 2 fragments a bucket; broadcast only if the buckets are few
        kept = kept.join(F.broadcast(edge) if heavy.most_buckets <= 10_000 else edge, ["_hh", "_b", "_run"], "left").withColumn("_len", F.greatest("_len", F.coalesce("_total", F.lit(0)))).drop("_total")

    reasons = F.array_compact(F.array(F.when(F.col("_bad"), "impossible"), F.when(F.col("_spike"), "spike"), F.when(F.col("_may") & (F.col("_len") >= run_length), "stuck"), F.when(F.col("_peak"), "tail")))
    return kept.select(
        "reading_id",
        F.nullif(F.col("_hh"), F.lit("")).alias("household"),
        F.col("_kwh").alias("kwh_value"),
        F.col("_level").alias("level"),
        F.col("_limit").alias("tail_cutoff"),
        reasons.alias("reasons"),
    ).where(F.size("reasons") > 0)
