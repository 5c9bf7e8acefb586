"""Queries of the profile engine: preprocessing, sampling, vectors, losses, calibration, attacks, schedules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadweave.functions import readings as R
from loadweave.functions import schedule as S
from loadweave.functions import vectors as V
from loadweave.operators import attacks, ecdf, etl, losses, mixture, ordering
from loadweave.sources import profiles as P
from loadweave.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- shared pieces of the oracle
RD = """rd AS (SELECT reading_id, upper(trim(LCLid)) AS household, CASE lower(trim(stdorToU)) WHEN 'std' THEN 'Std' WHEN 'tou' THEN 'ToU' END AS tariff, DateTime AS date_text,
 try_cast(replace(trim(DateTime), 'T', ' ') AS TIMESTAMP) AS dt, trim(kwh) AS kwh_text, ingested_at FROM lcl_data
 WHERE regexp_matches(upper(trim(LCLid)), '^MAC[0-9]+$') AND DateTime IS NOT NULL),
ft AS (SELECT *, CAST(dt AS DATE) AS date, CAST(month(dt) AS INTEGER) AS month, CAST(day(dt) AS INTEGER) AS day, CAST(isodow(dt) - 1 AS INTEGER) AS dayofweek, CAST(hour(dt) AS INTEGER) AS hour, CAST(minute(dt) AS INTEGER) AS minute,
 CAST(hour(dt) * 2 + CASE WHEN minute(dt) >= 30 THEN 1 ELSE 0 END + 1 AS INTEGER) AS settlement_period, CAST(last_day(dt) AS DATE) AS month_end FROM rd)"""
#: the same with the household of the other rows of the file where a reading has none
RDW = """fl AS (SELECT source_file, min(upper(trim(LCLid))) AS fhh FROM lcl_data WHERE regexp_matches(upper(trim(LCLid)), '^MAC[0-9]+$') GROUP BY 1),
lw AS (SELECT l.* REPLACE (CASE WHEN regexp_matches(upper(trim(l.LCLid)), '^MAC[0-9]+$') THEN l.LCLid ELSE f.fhh END AS LCLid) FROM lcl_data l LEFT JOIN fl f ON l.source_file = f.source_file),
""" + RD.replace("FROM lcl_data", "FROM lw")
VAL = "CASE WHEN kwh_text = 'Null' THEN 0.0 WHEN isfinite(try_cast(replace(kwh_text, ',', '.') AS DOUBLE)) THEN try_cast(replace(kwh_text, ',', '.') AS DOUBLE) END"
KL = f"kl AS (SELECT * FROM (SELECT *, {VAL} AS kwh, row_number() OVER (PARTITION BY household, date, settlement_period ORDER BY dt DESC, ingested_at DESC NULLS LAST, reading_id DESC) AS rn FROM ft) WHERE rn = 1)"
CD = "cd AS (SELECT * FROM (SELECT *, count(kwh) OVER (PARTITION BY household, date) AS n FROM kl) WHERE n = 48)"
PR = "pr AS (SELECT profile_id, kwh, month, dayofweek, source, split FROM lcl_profiles WHERE len(kwh) = 48 AND NOT list_contains(list_transform(kwh, lambda x: x IS NULL OR NOT isfinite(x)), true))"


def readings(spark: SparkSession, d: str) -> DataFrame:
    return etl.time_features(etl.clean_readings(table(spark, d, "lcl_data")))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Whole profiles: 48 finite values."""
    p = table(spark, d, "lcl_profiles")
    return p.where(F.coalesce(F.size("kwh") == 48, F.lit(False)) & F.forall("kwh", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))).select("profile_id", "kwh", "month", "dayofweek", "source", "split")


# ---------------------------------------------------------------- preprocessing
@query(f"WITH {RD} SELECT reading_id, date, month, day, dayofweek, hour, minute FROM ft")
def date_features(spark, d):
    return readings(spark, d).select("reading_id", "date", "month", "day", "dayofweek", "hour", "minute")


@query(f"WITH {RD} SELECT reading_id, CAST(date - CAST((dayofweek + 6) % 7 AS INTEGER) AS DATE) AS week FROM ft")
def week_start(spark, d):
    return readings(spark, d).select("reading_id", "week")


@query(f"WITH {RD} SELECT reading_id, month_end, CAST(day(month_end) AS INTEGER) AS month_max FROM ft")
def month_end(spark, d):
    return readings(spark, d).select("reading_id", "month_end", "month_max")


@query(f"WITH {RD} SELECT reading_id, settlement_period FROM ft")
def settlement_period(spark, d):
    return readings(spark, d).select("reading_id", "settlement_period")


@query(f"WITH {RD} SELECT reading_id, {VAL} AS kwh FROM rd")
def null_token(spark, d):
    return readings(spark, d).select("reading_id", etl.null_token(F.col("kwh_text")).alias("kwh"))


@query(f"WITH {RD}, {KL} SELECT reading_id, household, date, settlement_period, kwh FROM kl")
def dedupe_keep_last(spark, d):
    return etl.daily_readings(table(spark, d, "lcl_data")).select("reading_id", "household", "date", "settlement_period", "kwh")


@query(f"WITH {RD}, {KL} SELECT household, date, count(kwh) AS n FROM kl GROUP BY household, date")
def readings_per_day(spark, d):
    return etl.daily_readings(table(spark, d, "lcl_data")).groupBy("household", "date").agg(F.count("kwh").alias("n"))


@query(f"WITH {RD}, {KL}, {CD} SELECT reading_id, household, date, settlement_period, kwh FROM cd")
def complete_days(spark, d):
    return etl.complete_days(etl.daily_readings(table(spark, d, "lcl_data")), ["household", "date"], "kwh").select("reading_id", "household", "date", "settlement_period", "kwh")


@query(f"WITH {RD}, {KL}, {CD} SELECT household, tariff, month_end, month, dayofweek, day, date, list(kwh ORDER BY settlement_period) AS kwh FROM cd WHERE tariff IS NOT NULL GROUP BY ALL")
def pack_profiles(spark, d):
    return etl.readings_to_profiles(table(spark, d, "lcl_data"))


@query(f"WITH {RD}, {KL}, {CD} SELECT round(avg(kwh), 6) AS mean, round(stddev_pop(kwh), 6) AS stdev FROM cd")
def mean_std(spark, d):
    s = etl.mean_std(etl.complete_days(etl.daily_readings(table(spark, d, "lcl_data")), ["household", "date"], "kwh"))
    return s.select(r6("mean").alias("mean"), r6("stdev").alias("stdev"))


# The queries above, and those of periods and households below, follow their SQL, which leaves out readings without LCLid
# (pack_profiles also those without tariff). Their namesakes with _whole resolve both.
def whole_readings(spark, d):
    raw = table(spark, d, "lcl_data")
    return etl.time_features(etl.clean_readings(raw, R.learn_files(raw)))


def _whole_days(spark, d):
    raw = table(spark, d, "lcl_data")
    return etl.daily_readings(raw, R.learn_files(raw))


@query(f"WITH {RDW} SELECT reading_id, date, month, day, dayofweek, hour, minute FROM ft")
def date_features_whole(spark, d):
    return whole_readings(spark, d).select("reading_id", "date", "month", "day", "dayofweek", "hour", "minute")


@query(f"WITH {RDW} SELECT reading_id, CAST(date - CAST((dayofweek + 6) % 7 AS INTEGER) AS DATE) AS week FROM ft")
def week_start_whole(spark, d):
    return whole_readings(spark, d).select("reading_id", "week")


@query(f"WITH {RDW} SELECT reading_id, month_end, CAST(day(month_end) AS INTEGER) AS month_max FROM ft")
def month_end_whole(spark, d):
    return whole_readings(spark, d).select("reading_id", "month_end", "month_max")


@query(f"WITH {RDW} SELECT reading_id, settlement_period FROM ft")
def settlement_period_whole(spark, d):
    return whole_readings(spark, d).select("reading_id", "settlement_period")


@query(f"WITH {RDW} SELECT reading_id, {VAL} AS kwh FROM rd")
def null_token_whole(spark, d):
    return whole_readings(spark, d).select("reading_id", etl.null_token(F.col("kwh_text")).alias("kwh"))


@query(f"WITH {RDW}, {KL} SELECT reading_id, household, date, settlement_period, kwh FROM kl")
def dedupe_keep_last_whole(spark, d):
    return _whole_days(spark, d).select("reading_id", "household", "date", "settlement_period", "kwh")


@query(f"WITH {RDW}, {KL} SELECT household, date, count(kwh) AS n FROM kl GROUP BY household, date")
def readings_per_day_whole(spark, d):
    return _whole_days(spark, d).groupBy("household", "date").agg(F.count("kwh").alias("n"))


@query(f"WITH {RDW}, {KL}, {CD} SELECT reading_id, household, date, settlement_period, kwh FROM cd")
def complete_days_whole(spark, d):
    return etl.complete_days(_whole_days(spark, d), ["household", "date"], "kwh").select("reading_id", "household", "date", "settlement_period", "kwh")


@query(f"""WITH {RDW}, {KL}, {CD},
ht AS (SELECT household, tariff FROM (SELECT household, tariff, row_number() OVER (PARTITION BY household ORDER BY count(*) DESC, tariff) AS r FROM rd WHERE tariff IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
dt AS (SELECT household, date, tariff FROM (SELECT household, date, tariff, row_number() OVER (PARTITION BY household, date ORDER BY count(*) DESC, tariff) AS r FROM cd WHERE tariff IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1)
SELECT c.household, c.month_end, c.month, c.dayofweek, c.day, c.date, coalesce(any_value(dt.tariff), any_value(ht.tariff)) AS tariff, list(c.kwh ORDER BY c.settlement_period) AS kwh
FROM cd c LEFT JOIN dt ON dt.household = c.household AND dt.date = c.date LEFT JOIN ht ON ht.household = c.household GROUP BY 1, 2, 3, 4, 5, 6""")
def pack_profiles_whole(spark, d):
    return etl.whole_profiles(table(spark, d, "lcl_data"))


@query(f"WITH {RDW}, {KL}, {CD} SELECT round(avg(kwh), 6) AS mean, round(stddev_pop(kwh), 6) AS stdev FROM cd")
def mean_std_whole(spark, d):
    s = etl.mean_std(etl.complete_days(_whole_days(spark, d), ["household", "date"], "kwh"))
    return s.select(r6("mean").alias("mean"), r6("stdev").alias("stdev"))


_PERIOD = "CASE WHEN date_text BETWEEN '2014-01-01' AND '2014-12-31' THEN 'future' WHEN date_text BETWEEN '2012-01-01' AND '2013-12-31' THEN 'historical' END"


@query(f"WITH {RD} SELECT * FROM (SELECT reading_id, {_PERIOD} AS period FROM rd) WHERE period IS NOT NULL")
def period_split(spark, d):
    return readings(spark, d).select("reading_id", etl.period(F.col("date_text")).alias("period")).where("period is not null")


_GROUPS = """i AS (SELECT DISTINCT household FROM rd), k AS (SELECT household, row_number() OVER (ORDER BY md5(household || '|0'), household) AS pos, count(*) OVER () AS n FROM i),
g AS (SELECT household, 'train' AS household_group FROM k WHERE pos <= 200 UNION ALL SELECT household, 'holdout' FROM k WHERE pos > greatest(n - 200, 0))"""


@query(f"WITH {RD}, {_GROUPS} SELECT * FROM g")
def household_split(spark, d):
    return ordering.household_groups(readings(spark, d), "household", 200)


@query(f"WITH {RD}, {_GROUPS} SELECT household_group, period, count(*) AS n FROM (SELECT household, {_PERIOD} AS period FROM rd) JOIN g USING (household) WHERE period IS NOT NULL GROUP BY ALL")
def four_way_split(spark, d):
    return etl.four_way_split(readings(spark, d), 200).groupBy("household_group", "period").agg(F.count("*").alias("n"))


@query(f"WITH {RDW} SELECT * FROM (SELECT reading_id, {_PERIOD} AS period FROM rd) WHERE period IS NOT NULL")
def period_split_whole(spark, d):
    return whole_readings(spark, d).select("reading_id", etl.period(F.col("date_text")).alias("period")).where("period is not null")


#: groups of the production size
_GROUPS_WHOLE = _GROUPS.replace("200", "2000")


@query(f"WITH {RDW}, {_GROUPS_WHOLE} SELECT * FROM g")
def household_split_whole(spark, d):
    return ordering.household_groups(whole_readings(spark, d), "household", 2000)


@query(f"WITH {RDW}, {_GROUPS_WHOLE} SELECT household_group, period, count(*) AS n FROM (SELECT household, {_PERIOD} AS period FROM rd) JOIN g USING (household) WHERE period IS NOT NULL GROUP BY ALL")
def four_way_split_whole(spark, d):
    return etl.four_way_split(whole_readings(spark, d), 2000).groupBy("household_group", "period").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- vectors
_STD = "list_transform(kwh, lambda x: round((x - m.mean) / m.stdev, 6))"


def _with_stats(spark, d):
    stats = table(spark, d, "mean_std").first()  # a table of one row
    return table(spark, d, "lcl_profiles").withColumns({"_m": F.lit(stats["mean"]), "_s": F.lit(stats["stdev"])})


@query(f"SELECT profile_id, {_STD} AS z FROM lcl_profiles, mean_std m")
def standardise(spark, d):
    return _with_stats(spark, d).select("profile_id", V.rounded(V.standardise(F.col("kwh"), F.col("_m"), F.col("_s"))).alias("z"))


@query("SELECT profile_id, list_transform(kwh, lambda x: round(x, 6)) AS x FROM lcl_profiles")
def reconstruct_roundtrip(spark, d):
    z = V.standardise(F.col("kwh"), F.col("_m"), F.col("_s"))
    return _with_stats(spark, d).select("profile_id", V.rounded(V.reconstruct(z, F.col("_m"), F.col("_s"))).alias("x"))


@query("SELECT profile_id, list_transform(kwh, lambda x: CASE WHEN x IS NULL THEN NULL ELSE greatest(round(x - 0.1, 6), 0) END) AS x FROM lcl_profiles")
def clip_zero(spark, d):
    return table(spark, d, "lcl_profiles").select("profile_id", V.clip_zero(F.transform("kwh", lambda x: F.round(x - 0.1, 6))).alias("x"))


@query("SELECT profile_id, kwh AS x FROM lcl_profiles")
def parse_array_text(spark, d):
    return table(spark, d, "lcl_profiles").select("profile_id", V.parse_array(F.to_json("kwh", {"ignoreNullFields": "false"})).alias("x"))


@query("SELECT profile_id, list_concat(kwh, [CAST(month AS DOUBLE), CAST(dayofweek AS DOUBLE)]) AS x FROM lcl_profiles WHERE kwh IS NOT NULL AND month IS NOT NULL AND dayofweek IS NOT NULL")
def concat_features(spark, d):
    p = table(spark, d, "lcl_profiles").where("kwh is not null and month is not null and dayofweek is not null")
    return p.select("profile_id", V.concat_features(F.col("kwh"), F.col("month"), F.col("dayofweek")).alias("x"))


@query(f"WITH {PR} SELECT profile_id, kwh[1:46] AS latent, CAST(round_even(kwh[47] * 10, 0) AS INTEGER) AS a, CAST(round_even(kwh[48] * 10, 0) AS INTEGER) AS b FROM pr")
def parse_samples(spark, d):
    p = profiles(spark, d).select("profile_id", F.concat(F.slice("kwh", 1, 46), F.transform(F.slice("kwh", 47, 2), lambda x: x * 10)).alias("v"))
    return p.select("profile_id", *V.parse_sample(F.col("v"), 46, ["a", "b"]))


@query("SELECT min(month) AS month_lo, max(month) AS month_hi, min(dayofweek) AS dayofweek_lo, max(dayofweek) AS dayofweek_hi FROM lcl_profiles")
def feature_range(spark, d):
    r = mixture.feature_range(table(spark, d, "lcl_profiles"), ["month", "dayofweek"])
    return spark.createDataFrame([(*r["month"], *r["dayofweek"])], "month_lo int, month_hi int, dayofweek_lo int, dayofweek_hi int")


@query("SELECT profile_id FROM lcl_profiles WHERE month BETWEEN 3 AND 8 AND dayofweek BETWEEN 0 AND 4")
def range_mask(spark, d):
    return mixture.in_range(table(spark, d, "lcl_profiles"), {"month": (3, 8), "dayofweek": (0, 4)}).select("profile_id")


@query(f"WITH {PR} SELECT profile_id, round(sqrt(list_sum(list_transform(kwh, lambda x: x * x))), 6) AS norm FROM pr")
def vector_norm(spark, d):
    return profiles(spark, d).select("profile_id", r6(V.norm(F.col("kwh"))).alias("norm"))


# ---------------------------------------------------------------- order
_POS = "p AS (SELECT profile_id, split, source, stdorToU, month, row_number() OVER (ORDER BY md5(CAST(profile_id AS VARCHAR) || '|0'), profile_id) AS pos, count(*) OVER () AS n FROM lcl_profiles)"


@query(f"WITH {_POS} SELECT profile_id FROM p WHERE pos <= 500")
def exact_sample(spark, d):
    return ordering.exact_sample(table(spark, d, "lcl_profiles"), "profile_id", 500).select("profile_id")


@query(f"WITH {_POS} SELECT profile_id, pos FROM p")
def shuffle_positions(spark, d):
    return ordering.shuffle_positions(table(spark, d, "lcl_profiles"), "profile_id").select("profile_id", "pos")


@query(f"WITH {_POS} SELECT profile_id, CAST((pos - 1) // 300 AS BIGINT) AS batch_id FROM p WHERE (pos - 1) // 300 < n // 300")
def batches_drop_last(spark, d):
    return ordering.batches(table(spark, d, "lcl_profiles"), "profile_id", 300).select("profile_id", "batch_id")


@query(f"WITH {_POS.replace('|0', '|100')} SELECT profile_id, CASE WHEN pos <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'eval' END AS part FROM p")
def train_eval_split(spark, d):
    return ordering.train_eval_split(table(spark, d, "lcl_profiles"), "profile_id").select("profile_id", "part")


@query("SELECT profile_id, unnest(range(1, CAST(month % 4 + 1 AS BIGINT))) AS copy FROM lcl_profiles")
def expand_weights(spark, d):
    return ordering.expand_by_weight(table(spark, d, "lcl_profiles").withColumn("w", F.col("month") % 4), "w").select("profile_id", F.col("copy").cast("long").alias("copy"))


@query("SELECT LCLid, date, kwh, NULL AS segment FROM lcl_profiles UNION ALL SELECT LCLid, date, kwh, segment FROM lcl_outliers")
def union_missing(spark, d):
    a = table(spark, d, "lcl_profiles").select("LCLid", "date", "kwh")
    return a.unionByName(table(spark, d, "lcl_outliers").select("LCLid", "date", "kwh", "segment"), allowMissingColumns=True)


@query("SELECT profile_id, CAST(unnest(range(1, len(kwh) + 1)) AS INTEGER) AS slot, unnest(kwh) AS x FROM lcl_profiles")
def wide_to_long(spark, d):
    return table(spark, d, "lcl_profiles").select("profile_id", F.posexplode("kwh").alias("p", "x")).select("profile_id", (F.col("p") + 1).alias("slot"), "x")


@query(f"WITH {_POS} SELECT profile_id, CAST(CASE WHEN pos - 1 < (n % 5) * (n // 5 + 1) THEN (pos - 1) // (n // 5 + 1) ELSE n % 5 + (pos - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS shard FROM p")
def shard_assignment(spark, d):
    return P.shard_assignment(table(spark, d, "lcl_profiles"), "profile_id", 5).select("profile_id", "shard")


# ---------------------------------------------------------------- losses
#: predicted and real: a profile and the one before it in id order
_PAIRS = f"{PR}, q AS (SELECT profile_id, month, kwh AS r, lag(kwh) OVER (ORDER BY profile_id) AS p FROM pr), e AS (SELECT profile_id, month % 3 + 1 AS w, unnest(p) AS p, unnest(r) AS r FROM q WHERE p IS NOT NULL)"


def pairs(spark, d):
    """Neighbours in id order meet by rank, so no window runs over the whole table."""
    p = ordering.key_positions(profiles(spark, d), "profile_id")
    before = p.select((F.col("pos") + 1).alias("pos"), F.col("kwh").alias("p"))
    return p.select("profile_id", "month", "pos", F.col("kwh").alias("r"), (F.col("month") % 3 + 1).alias("w")).join(before, "pos")


@query(f"WITH {_PAIRS} SELECT round(avg(greatest(0.9 * (r - p), 0.1 * (p - r))), 6) AS loss FROM e")
def quantile_loss(spark, d):
    x = pairs(spark, d)
    return x.agg(r6(losses.quantile_loss(x, "p", "r", 0.9)).alias("loss"))


@query(f"WITH {_PAIRS} SELECT round(sum(w * greatest(0.5 * (r - p), 0.5 * (p - r))) / sum(w), 6) AS loss FROM e")
def quantile_loss_weighted(spark, d):
    x = pairs(spark, d)
    return x.agg(r6(losses.quantile_loss(x, "p", "r", 0.5, "w")).alias("loss"))


@query(f"WITH {_PAIRS} SELECT round(avg((p - r) * (p - r)), 6) AS loss FROM e")
def mse_loss(spark, d):
    x = pairs(spark, d)
    return x.agg(r6(losses.mse_loss(x, "p", "r")).alias("loss"))


@query(f"WITH {_PAIRS} SELECT round(sum(w * (p - r) * (p - r)) / sum(w), 6) AS loss FROM e")
def mse_loss_weighted(spark, d):
    x = pairs(spark, d)
    return x.agg(r6(losses.mse_loss(x, "p", "r", "w")).alias("loss"))


@query(f"""WITH {_PAIRS} SELECT round(0.25 + 2 * avg((p - r) * (p - r)) + avg(4 * greatest(0.95 * (r - p), 0.05 * (p - r)) + greatest(0.05 * (r - p), 0.95 * (p - r)) + 4 * greatest(0.5 * (r - p), 0.5 * (p - r))), 6) AS total,
round(2 * avg((p - r) * (p - r)), 6) AS mse, round(avg(4 * greatest(0.95 * (r - p), 0.05 * (p - r)) + greatest(0.05 * (r - p), 0.95 * (p - r)) + 4 * greatest(0.5 * (r - p), 0.5 * (p - r))), 6) AS quantile FROM e""")
def training_loss(spark, d):
    out = losses.training_loss(pairs(spark, d), "p", "r", F.lit(0.25))
    return out.select(r6("total").alias("total"), r6("mse").alias("mse"), r6("quantile").alias("quantile"))


_MMD = """WITH b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 2 AS s, 1 + label % 3 AS w, (vec_id // 2) // 25 AS batch FROM embeddings),
d AS (SELECT a.batch, a.s AS sa, c.s AS sb, a.w * c.w AS ww, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i]))) AS d2 FROM b a JOIN b c ON a.batch = c.batch)
SELECT batch, round(sum((exp(-d2 / 20) + exp(-d2 / 30) + exp(-d2 / 40) + exp(-d2 / 100)) * CASE WHEN sa = sb THEN 1 ELSE -1 END * {w}) / {n}, 6) AS mmd FROM d GROUP BY batch"""


def _mmd_input(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 2).alias("s"), (1 + F.col("label") % 3).alias("w"), F.expr("(vec_id div 2) div 25").alias("batch"))


@query(_MMD.format(w="1", n="(sum(CASE WHEN sa = 0 AND sb = 0 THEN 1 ELSE 0 END))"))
def mmd(spark, d):
    return losses.mmd(_mmd_input(spark, d), "batch", "s", "v", "vec_id").select("batch", r6("mmd").alias("mmd"))


@query(_MMD.format(w="ww", n="(sum(CASE WHEN sa = 0 AND sb = 0 THEN ww ELSE 0 END))"))
def mmd_weighted(spark, d):
    return losses.mmd(_mmd_input(spark, d), "batch", "s", "v", "vec_id", "w").select("batch", r6("mmd").alias("mmd"))


@query("SELECT round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y), 6) AS loss FROM (SELECT (value - 50) / 50 AS z, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y FROM events)")
def bce_loss(spark, d):
    e = table(spark, d, "events").select(((F.col("value") - 50) / 50).alias("z"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("y"))
    return e.agg(r6(losses.bce_on_logits(F.col("z"), F.col("y"))).alias("loss"))


@query("""SELECT kind, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95 FROM
(SELECT kind, unnest(range(0, len(kwh))) AS pos, unnest(kwh) AS x FROM reconstruction_attack_dataset WHERE kwh IS NOT NULL) WHERE x IS NOT NULL AND isfinite(x) GROUP BY kind, pos""")
def profile_stats(spark, d):
    df = table(spark, d, "reconstruction_attack_dataset").withColumn("kwh", F.transform("kwh", lambda x: F.when(F.abs(x) < float("inf"), x)))
    return losses.profile_stats(df, "kwh", "kind").select("kind", "pos", *[r6(c).alias(c) for c in ("mean", "median", "p95")])


# ---------------------------------------------------------------- calibration
_LONG = """lg AS (SELECT sample_id, kind, CAST(pos AS INTEGER) AS pos, x FROM (SELECT sample_id, kind, unnest(range(0, len(kwh))) AS pos, unnest(kwh) AS x FROM reconstruction_attack_dataset WHERE kwh IS NOT NULL) WHERE isfinite(x)),
t AS (SELECT * FROM lg WHERE kind = 'real_samples'), s AS (SELECT * FROM lg WHERE kind = 'synthetic_samples')"""


def _long(spark, d, kind):
    df = table(spark, d, "reconstruction_attack_dataset").where(F.col("kind") == kind)
    return ecdf.long_form(df, "sample_id", "kwh").where(F.abs("x") < float("inf"))


@query(f"WITH {_LONG} SELECT DISTINCT pos, x, round(cume_dist() OVER (PARTITION BY pos ORDER BY x), 6) AS cdf FROM t")
def ecdf_values(spark, d):
    return ecdf.cdf(ecdf.fit(_long(spark, d, "real_samples"), "sample_id")).select("pos", "x", r6("cdf").alias("cdf"))


@query(f"""WITH {_LONG}, u AS (SELECT pos, x, NULL AS sample_id, 1 AS f FROM t UNION ALL SELECT pos, x, sample_id, 0 FROM s)
SELECT sample_id, pos, round(b / n, 6) AS p FROM (SELECT *, sum(f) OVER (PARTITION BY pos ORDER BY x RANGE UNBOUNDED PRECEDING) AS b, sum(f) OVER (PARTITION BY pos) AS n FROM u) WHERE f = 0""")
def ecdf_transform(spark, d):
    return ecdf.transform(ecdf.fit(_long(spark, d, "real_samples"), "sample_id"), _long(spark, d, "synthetic_samples"), "sample_id").select("sample_id", "pos", r6("p").alias("p"))


@query(f"""WITH {_LONG}, o AS (SELECT pos, x, row_number() OVER (PARTITION BY pos ORDER BY x, sample_id) AS k, count(*) OVER (PARTITION BY pos) AS n FROM t),
z AS (SELECT DISTINCT pos, n FROM o) SELECT q.id, z.pos, o.x FROM (SELECT unnest(range(0, 101)) AS id) q, z JOIN o ON o.pos = z.pos AND o.k = greatest(1, least(z.n, CAST(floor(q.id / 100 * z.n) AS BIGINT)))""")
def ecdf_inverse(spark, d):
    fitted = ecdf.fit(_long(spark, d, "real_samples"), "sample_id")
    asked = spark.range(101).select("id", (F.col("id") / 100).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(47))).alias("pos"))
    return ecdf.inverse(fitted, asked, "id")


@query(f"""WITH {_LONG}, o AS (SELECT pos, x AS calibrated, row_number() OVER (PARTITION BY pos ORDER BY x, sample_id) AS k FROM t), z AS (SELECT pos, count(*) AS nt FROM t GROUP BY pos),
r AS (SELECT sample_id, pos, x, count(*) OVER (PARTITION BY pos ORDER BY x RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER (PARTITION BY pos) AS ns FROM s)
SELECT r.sample_id, r.pos, r.x, o.calibrated FROM r JOIN z ON r.pos = z.pos JOIN o ON o.pos = r.pos AND o.k = greatest(1, least(z.nt, r.r * z.nt // r.ns))""")
def calibrate(spark, d):
    return ecdf.calibrate(_long(spark, d, "real_samples"), _long(spark, d, "synthetic_samples"), "sample_id")


# ---------------------------------------------------------------- attacks
_VEC = "v AS (SELECT sample_id AS id, kind, segment, kwh AS v FROM reconstruction_attack_dataset WHERE len(kwh) = 48 AND NOT list_contains(list_transform(kwh, lambda x: x IS NULL OR NOT isfinite(x)), true)), o AS (SELECT row_number() OVER (ORDER BY LCLid, date) AS id, kwh AS v FROM lcl_outliers)"
_DIST = f"{_VEC}, dd AS (SELECT o.id AS real_outlier, v.id AS synthetic_output, sqrt(list_sum(list_transform(range(1, 49), lambda i: (o.v[i] - v.v[i]) * (o.v[i] - v.v[i])))) AS euc_dist, sqrt(list_sum(list_transform(o.v, lambda x: x * x))) AS norm FROM o, v WHERE v.kind = 'synthetic_samples')"


def vectors(spark, d):
    df = table(spark, d, "reconstruction_attack_dataset").select(F.col("sample_id").alias("id"), "kind", "segment", F.col("kwh").alias("v"))
    return df.where(F.coalesce(F.size("v") == 48, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def outliers(spark, d):
    # a fixed table of 100 rows, numbered in one order
    return table(spark, d, "lcl_outliers").select(F.row_number().over(Window.orderBy("LCLid", "date")).alias("id"), F.col("kwh").alias("v"))


@query(f"WITH {_DIST} SELECT real_outlier, count(*) AS n, round(avg(euc_dist), 6) AS mean_dist, round(max(norm), 6) AS norm FROM dd GROUP BY 1")
def pairwise_distance(spark, d):
    x = attacks.distances(outliers(spark, d), vectors(spark, d).where("kind = 'synthetic_samples'"))
    return x.groupBy("real_outlier").agg(F.count("*").alias("n"), r6(F.avg("euc_dist")).alias("mean_dist"), r6(F.max("norm")).alias("norm"))


@query(f"WITH {_DIST} SELECT real_outlier, round(min(euc_dist / norm), 6) AS ratio FROM dd GROUP BY 1")
def nearest_ratio(spark, d):
    return attacks.nearest_ratio(outliers(spark, d), vectors(spark, d).where("kind = 'synthetic_samples'")).select("real_outlier", r6("ratio").alias("ratio"))


@query(f"WITH {_DIST}, m AS (SELECT real_outlier, min(euc_dist / norm) AS ratio FROM dd GROUP BY 1) SELECT round(avg(CASE WHEN ratio <= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM m")
def ratio_under_threshold(spark, d):
    return attacks.under_threshold(attacks.nearest_ratio(outliers(spark, d), vectors(spark, d).where("kind = 'synthetic_samples'"))).select(r6("share").alias("share"), "n")


@query(f"WITH {_DIST}, m AS (SELECT real_outlier, min(euc_dist / norm) AS ratio FROM dd GROUP BY 1) SELECT real_outlier, round(cume_dist() OVER (ORDER BY ratio), 6) AS cdf FROM m")
def ratio_ecdf(spark, d):
    m = attacks.nearest_ratio(outliers(spark, d), vectors(spark, d).where("kind = 'synthetic_samples'"))
    return m.select("real_outlier", r6(F.cume_dist().over(Window.orderBy("ratio"))).alias("cdf"))  # one row per stated outlier


@query(f"WITH {_VEC} SELECT id, CASE kind WHEN 'synthetic_samples' THEN 1 ELSE 0 END AS target FROM v WHERE kind <> 'outlier_samples'")
def mia_train_set(spark, d):
    v = vectors(spark, d)
    return attacks.attack_train_set(v.where("kind = 'real_samples'"), v.where("kind = 'synthetic_samples'")).select("id", "target")


@query(f"WITH {_VEC} SELECT id, CASE WHEN kind = 'outlier_samples' THEN 1 ELSE 0 END AS target, CASE kind WHEN 'outlier_samples' THEN 'seen' WHEN 'real_samples' THEN 'unseen_same' ELSE 'unseen_diff' END AS type FROM v")
def mia_attack_set(spark, d):
    v = vectors(spark, d)
    return attacks.attack_set(v.where("kind = 'outlier_samples'"), v.where("kind = 'real_samples'"), v.where("kind = 'synthetic_samples'")).select("id", "target", "type")


_RANK = "r AS (SELECT event_id, y, CASE WHEN row_number() OVER (ORDER BY value DESC, event_id) <= (SELECT sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) FROM events) THEN 1 ELSE 0 END AS rank_pred FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events))"


def _ranked(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"))
    return attacks.rank_predictions(e, "value", "y", "event_id")


@query(f"WITH {_RANK} SELECT event_id, rank_pred FROM r")
def mia_rank(spark, d):
    return _ranked(spark, d).select("event_id", "rank_pred")


@query(f"""WITH {_RANK}, m AS (SELECT count(*) AS n, sum(y) AS positives, sum(CASE WHEN y = 1 AND rank_pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND rank_pred = 1 THEN 1 ELSE 0 END) AS fp, avg(CASE WHEN y = rank_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM r)
SELECT n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(accuracy, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(2 * (tp / (tp + fp)) * (tp / positives) / ((tp / (tp + fp)) + (tp / positives)), 6) AS f1,
round(positives / n, 6) AS random_precision, round(1.96 * sqrt(tp / (tp + fp) * (1 - tp / (tp + fp)) / n), 6) AS interval FROM m""")
def mia_metrics(spark, d):
    m = attacks.attack_metrics(_ranked(spark, d), "y")
    return m.select("n", "tp", "fp", *[r6(c).alias(c) for c in ("accuracy", "precision", "f1", "random_precision", "interval")])


# ---------------------------------------------------------------- schedules
_LIN = "b AS (SELECT CAST(t AS INTEGER) AS t, 0.001 + t * (0.2 - 0.001) / 99 AS beta FROM (SELECT unnest(range(0, 100)) AS t))"
_COS = "b AS (SELECT CAST(t AS INTEGER) AS t, least(greatest(1 - pow(cos(((t + 1) / 100 + 0.008) / 1.008 * pi() / 2), 2) / pow(cos((t / 100 + 0.008) / 1.008 * pi() / 2), 2), 0), 0.999) AS beta FROM (SELECT unnest(range(0, 100)) AS t))"
_BAR = "a AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS bar FROM b), c AS (SELECT *, coalesce(lag(bar) OVER (ORDER BY t), 1) AS prev FROM a)"


def _coefs(spark, kind="linear", steps=100):
    return S.coefficient_table(S.beta_table(spark, kind, steps))


@query(f"WITH {_LIN} SELECT t, round(beta, 9) AS beta FROM b")
def beta_linear(spark, d):
    return S.beta_table(spark, "linear", 100).select("t", F.round("beta", 9).alias("beta"))


@query(f"WITH {_COS} SELECT t, round(beta, 9) AS beta FROM b")
def beta_cosine(spark, d):
    return S.beta_table(spark, "cosine", 100).select("t", F.round("beta", 9).alias("beta"))


@query(f"WITH {_LIN}, {_BAR} SELECT t, round(bar, 9) AS alpha_bar, round(prev, 9) AS alpha_bar_prev FROM c")
def alpha_bar(spark, d):
    return _coefs(spark).select("t", F.round("alpha_bar", 9).alias("alpha_bar"), F.round("alpha_bar_prev", 9).alias("alpha_bar_prev"))


@query(f"""WITH {_LIN}, {_BAR}, p AS (SELECT *, beta * (1 - prev) / (1 - bar) AS pv FROM c) SELECT t, round(pv, 6) AS posterior_variance, round(ln(CASE WHEN t = 0 THEN lead(pv) OVER (ORDER BY t) ELSE pv END), 6) AS posterior_log_variance,
round(beta * sqrt(prev) / (1 - bar), 6) AS posterior_mean_x0, round((1 - prev) * sqrt(1 - beta) / (1 - bar), 6) AS posterior_mean_xt, round(sqrt(1 / bar), 6) AS recip_sqrt FROM p""")
def posterior_coefs(spark, d):
    return _coefs(spark).select("t", *[r6(c).alias(c) for c in ("posterior_variance", "posterior_log_variance", "posterior_mean_x0", "posterior_mean_xt", "recip_sqrt")])


@query(f"WITH {_LIN}, {_BAR} SELECT t, CAST(1 AS DOUBLE) AS noise, round(bar / (1 - bar), 6) AS x_start, round(bar / (1 - bar) / (bar / (1 - bar) + 1), 6) AS v FROM c")
def loss_weights(spark, d):
    return S.loss_weights(_coefs(spark)).select("t", "noise", r6("x_start").alias("x_start"), r6("v").alias("v"))


#: start x_0, and as fixed noise the reversed profile; the step follows the id
_QS = f"{PR}, {_LIN}, {_BAR}, x AS (SELECT profile_id, kwh AS x0, list_reverse(kwh) AS e, bar FROM pr JOIN c ON c.t = profile_id % 100)"


def _noised(spark, d):
    p = profiles(spark, d).select("profile_id", F.col("kwh").alias("x0"), F.reverse("kwh").alias("e"), (F.col("profile_id") % 100).cast("int").alias("t"))
    # a schedule has as many rows as steps, 100 here
    return p.join(F.broadcast(_coefs(spark)), "t")


@query(f"WITH {_QS} SELECT profile_id, list_transform(range(1, 49), lambda i: round(sqrt(bar) * x0[i] + sqrt(1 - bar) * e[i], 6)) AS xt FROM x")
def q_sample(spark, d):
    return _noised(spark, d).select("profile_id", V.rounded(S.q_sample("x0", "e", {k: F.col(k) for k in ("sqrt_alpha_bar", "sqrt_one_minus")})).alias("xt"))


@query(f"WITH {_QS} SELECT profile_id, list_transform(range(1, 49), lambda i: round(sqrt(bar) * e[i] - sqrt(1 - bar) * x0[i], 6)) AS v FROM x")
def v_from_noise(spark, d):
    c = {k: F.col(k) for k in ("sqrt_alpha_bar", "sqrt_one_minus")}
    return _noised(spark, d).select("profile_id", V.rounded(S.v_from_noise("x0", "e", c)).alias("v"))


@query(f"WITH {PR} SELECT profile_id, list_transform(kwh, lambda x: round(x, 6)) AS x FROM pr")
def start_from_v(spark, d):
    c = {k: F.col(k) for k in ("sqrt_alpha_bar", "sqrt_one_minus")}
    x = _noised(spark, d).withColumn("xt", S.q_sample("x0", "e", c)).withColumn("v", S.v_from_noise("x0", "e", c))
    return x.select("profile_id", V.rounded(S.start_from_v("xt", "v", c)).alias("x"))


@query(f"WITH {PR} SELECT profile_id, list_transform(kwh, lambda x: round(x, 6)) AS x FROM pr")
def start_from_noise(spark, d):
    c = {k: F.col(k) for k in ("sqrt_alpha_bar", "sqrt_one_minus", "recip_sqrt", "recip_minus_one_sqrt")}
    x = _noised(spark, d).withColumn("xt", S.q_sample("x0", "e", c))
    return x.select("profile_id", V.rounded(S.start_from_noise("xt", "e", c)).alias("x"))


@query(f"WITH {_QS} SELECT round(avg(list_sum(list_transform(range(1, 49), lambda i: (x0[i] - e[i]) * (x0[i] - e[i]))) / 48), 6) AS loss FROM x")
def diffusion_mse(spark, d):
    x = _noised(spark, d)
    return x.agg(r6(F.avg(V.squared_distance(F.col("x0"), F.col("e")) / 48)).alias("loss"))


_W = f"exp(-i * ln(10000) / {32 / 2 - 1})"


@query(f"SELECT CAST(p AS INTEGER) AS p, list_concat(list_transform(range(0, 16), lambda i: round(sin(p * {_W}), 6)), list_transform(range(0, 16), lambda i: round(cos(p * {_W}), 6))) AS e FROM (SELECT unnest(range(0, 48)) AS p)")
def sinusoidal_embedding(spark, d):
    return spark.range(48).select(F.col("id").cast("int").alias("p"), V.rounded(V.sinusoidal_embedding(F.col("id").cast("double"), 32)).alias("e"))


@query("SELECT CAST(i AS INTEGER) AS i, round(1 + i * (0.001 - 1) / 20, 9) AS uniform, round(pow(1 + i * (sqrt(0.001) - 1) / 20, 2), 9) AS quadratic FROM (SELECT unnest(range(0, 21)) AS i)")
def time_steps(spark, d):
    ns = S.NoiseSchedule(S.Schedule.LINEAR)
    a, b = S.time_steps(ns, "time_uniform", 1.0, 0.001, 20), S.time_steps(ns, "time_quadratic", 1.0, 0.001, 20)
    return spark.createDataFrame([(i, round(float(x), 9), round(float(y), 9)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, uniform double, quadratic double")


@query("SELECT CAST(i AS INTEGER) AS i, round(la - 0.5 * ln(1 - exp(2 * la)), 6) AS lambda, round(t, 6) AS back FROM (SELECT i, i / 100 AS t, -0.25 * pow(i / 100, 2) * 19.9 - 0.5 * (i / 100) * 0.1 AS la FROM (SELECT unnest(range(1, 101)) AS i))")
def schedule_lambda(spark, d):
    ns = S.NoiseSchedule(S.Schedule.LINEAR)
    rows = [(i, round(float(ns.lam(i / 100)), 6), round(float(ns.inverse_lam(ns.lam(i / 100))), 6)) for i in range(1, 101)]
    return spark.createDataFrame(rows, "i int, lambda double, back double")


@query("""WITH k AS (SELECT unnest(range(0, 11)) AS x), s AS (SELECT x, x * x AS y, lead(x) OVER (ORDER BY x) AS x2, lead(x * x) OVER (ORDER BY x) AS y2 FROM k), q AS (SELECT i, i / 10 - 2 AS v FROM (SELECT unnest(range(0, 141)) AS i))
SELECT CAST(i AS INTEGER) AS i, round(y + (v - x) * (y2 - y) / (x2 - x), 6) AS y FROM q JOIN s ON x2 IS NOT NULL AND (v > x OR x = 0) AND (v <= x2 OR x = 9)""")
def interpolate(spark, d):
    import numpy as np

    xp = np.arange(11.0)
    y = S.interpolate(np.arange(141) / 10 - 2, xp, xp**2)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(y)], "i int, y double")


# ---------------------------------------------------------------- mixture at fixed parameters
def _fixed_mixture() -> mixture.Mixture:
    import numpy as np

    cov = np.array([0.04 * np.eye(3), 0.25 * np.eye(3)])
    return mixture.Mixture(np.array([0.6, 0.4]), np.array([[0.2, 0.2, 0.2], [0.6, 0.6, 0.6]]), cov, mixture.precision_cholesky(cov))


_GM = f"""{PR}, x AS (SELECT profile_id, kwh[1] AS a, kwh[17] AS b, kwh[33] AS c FROM pr),
l AS (SELECT *, ln(0.6) - 0.5 * (3 * ln(2 * pi()) + (pow(a - 0.2, 2) + pow(b - 0.2, 2) + pow(c - 0.2, 2)) / 0.04) - 3 * ln(0.2) AS l0,
 ln(0.4) - 0.5 * (3 * ln(2 * pi()) + (pow(a - 0.6, 2) + pow(b - 0.6, 2) + pow(c - 0.6, 2)) / 0.25) - 3 * ln(0.5) AS l1 FROM x),
e AS (SELECT *, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS ll FROM l), r AS (SELECT *, exp(l0 - ll) AS r0, exp(l1 - ll) AS r1 FROM e)"""


def _points(spark, d):
    return profiles(spark, d).select("profile_id", F.array(F.col("kwh")[0], F.col("kwh")[16], F.col("kwh")[32]).alias("v"))


@query(f"WITH {_GM} SELECT profile_id, round(ll, 6) AS log_likelihood, [round(r0, 6), round(r1, 6)] AS responsibilities FROM r")
def gmm_e_step(spark, d):
    return mixture.score(_points(spark, d), "profile_id", "v", _fixed_mixture()).select("profile_id", r6("log_likelihood").alias("log_likelihood"), V.rounded(F.col("responsibilities")).alias("responsibilities"))


@query(f"WITH {_GM} SELECT profile_id, CASE WHEN l0 >= l1 THEN 0 ELSE 1 END AS component FROM r")
def gmm_predict(spark, d):
    return mixture.score(_points(spark, d), "profile_id", "v", _fixed_mixture()).select("profile_id", "component")


@query(f"WITH {_GM} SELECT round(-avg(ll), 6) AS nll FROM r")
def gmm_nll(spark, d):
    m = mixture.em_round(_points(spark, d), "v", _fixed_mixture(), 1e-4)
    return spark.createDataFrame([(round(float(m.nll), 6),)], "nll double")


@query(f"""WITH {_GM}, m AS (SELECT 0 AS component, r0 AS w, a, b, c FROM r UNION ALL SELECT 1, r1, a, b, c FROM r), n AS (SELECT component, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * c) / sum(w) AS mc FROM m GROUP BY component)
SELECT m.component, round(max(n.n) / (SELECT sum(n) FROM n), 6) AS weight, [round(max(ma), 6), round(max(mb), 6), round(max(mc), 6)] AS mean, round(sum(w * pow(a - ma, 2)) / max(n.n) + 0.0001, 6) AS var_a, round(sum(w * (a - ma) * (b - mb)) / max(n.n), 6) AS cov_ab FROM m JOIN n USING (component) GROUP BY m.component""")
def gmm_m_step(spark, d):
    m = mixture.em_round(_points(spark, d), "v", _fixed_mixture(), 1e-4)
    rows = [(k, round(float(m.weights[k]), 6), [round(float(x), 6) for x in m.means[k]], round(float(m.covariances[k][0, 0]), 6), round(float(m.covariances[k][0, 1]), 6)) for k in range(2)]
    return spark.createDataFrame(rows, "component int, weight double, mean array<double>, var_a double, cov_ab double")


@query(f"WITH {PR}, x AS (SELECT profile_id, kwh[1] AS a, kwh[17] AS b, kwh[33] AS c FROM pr) SELECT profile_id, CASE WHEN pow(a - 0.2, 2) + pow(b - 0.2, 2) + pow(c - 0.2, 2) <= pow(a - 0.6, 2) + pow(b - 0.6, 2) + pow(c - 0.6, 2) THEN 0 ELSE 1 END AS label FROM x")
def kmeans_assign(spark, d):
    centres = [[0.2] * 3, [0.6] * 3]
    dist = [V.squared_distance(F.col("v"), F.array(*[F.lit(x) for x in c])) for c in centres]
    return _points(spark, d).select("profile_id", F.when(dist[0] <= dist[1], 0).otherwise(1).alias("label"))
