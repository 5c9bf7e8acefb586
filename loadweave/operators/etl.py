"""Readings to daily profiles: time features, null tokens, keep-last dedupe, complete days, packing, splits, stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.functions import readings as R
from loadweave.operators.ordering import household_groups
from loadweave.sources import profiles as P

#: fixed values: the two evaluation periods, compared as text
PERIODS = {"historical": ("2012-01-01", "2013-12-31"), "future": ("2014-01-01", "2014-12-31")}


def clean_readings(raw: DataFrame, known: R.FileDictionary | None = None) -> DataFrame:
    """reading_id, household, tariff, date_text, dt, kwh_text, ingested_at of rows that have a household and a time.

    With known (learn_files) a row without id has the household of its source_file; without it such a row is dropped.
    """
    if known is None:
        own = raw.withColumn("household", R.household_id(F.col("LCLid")))
    else:
        own = R.with_household(raw.select("reading_id", "LCLid", "stdorToU", "DateTime", "kwh", "ingested_at", "source_file"), "household", known)
    dt = F.trim("DateTime").try_cast("timestamp")
    out = own.select("reading_id", "household", R.tariff(F.col("stdorToU")).alias("tariff"), F.col("DateTime").alias("date_text"), dt.alias("dt"), F.col("kwh").alias("kwh_text"), "ingested_at")
    return out.where("household is not null and dt is not null")


def time_features(df: DataFrame, ts: str = "dt") -> DataFrame:
    """date, month, day, dayofweek (Monday 0), hour, minute, week (starting Tuesday), month_end, month_max, settlement_period."""
    t = F.col(ts)
    return df.withColumns(
        {
            "date": F.to_date(t),
            "month": F.month(t),
            "day": F.dayofmonth(t),
            "dayofweek": F.weekday(t),
            "hour": F.hour(t),
            "minute": F.minute(t),
            "week": F.date_sub(F.to_date(t), F.pmod(F.weekday(t) - 1, F.lit(7)).cast("int")),
            "month_end": F.last_day(t),
            "month_max": F.dayofmonth(F.last_day(t)),
            "settlement_period": F.hour(t) * 2 + F.when(F.minute(t) >= 30, 1).otherwise(0) + 1,
        }
    )


def null_token(col: Column, tokens: tuple[str, ...] = ("Null",)) -> Column:
    """A token becomes 0.0 before anything is counted; other text that is no number stays missing."""
    return F.when(F.trim(col).isin(list(tokens)), F.lit(0.0)).otherwise(R.number(col))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by an explicit order; never an arbitrary survivor."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_lw_rn", F.row_number().over(w)).where("_lw_rn = 1").drop("_lw_rn")


def complete_days(df: DataFrame, keys: list[str], value: str, required: int = 48) -> DataFrame:
    """Rows of the days with exactly `required` non-null values, by a window instead of a count joined back."""
    return df.withColumn("_lw_n", F.count(value).over(Window.partitionBy(*keys))).where(F.col("_lw_n") == required).drop("_lw_n")


def pack(df: DataFrame, keys: list[str], slot: str, value: str, out: str) -> DataFrame:
    """One array per key, ordered by slot; null keys are dropped."""
    pairs = F.array_sort(F.collect_list(F.struct(slot, value)))
    return df.na.drop(subset=keys).groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias(out))


def household_tariffs(cleaned: DataFrame) -> DataFrame:
    """(household, _lw_tariff): the tariff a household's readings name most often, ties to the smallest."""
    pairs = cleaned.where("tariff is not null").groupBy("household", "tariff").agg(F.count("*").alias("_lw_n"))
    return pairs.groupBy("household").agg(F.min(F.struct((-F.col("_lw_n")).alias("n"), "tariff")).alias("_lw_best")).select("household", F.col("_lw_best.tariff").alias("_lw_tariff"))


def pack_days(df: DataFrame, keys: list[str], slot: str, value: str, out: str, tariffs: DataFrame) -> DataFrame:
    """As pack with the tariff after the keys, but no reading goes for want of a tariff: the day's, else its household's, else null."""
    pairs = F.array_sort(F.collect_list(F.struct(slot, value)))
    days = df.na.drop(subset=keys).groupBy(*keys).agg(F.mode("tariff", True).alias("tariff"), F.transform(pairs, lambda x: x[value]).alias(out))
    return days.join(tariffs, "household", "left").withColumn("tariff", F.coalesce("tariff", "_lw_tariff")).select(*keys, "tariff", out)


def daily_readings(raw: DataFrame, known: R.FileDictionary | None = None) -> DataFrame:
    """Cleaned, featured and deduplicated readings: one row per household, date and settlement period."""
    df = time_features(clean_readings(raw, known)).withColumn("kwh", null_token(F.col("kwh_text")))
    return keep_last(df, ["household", "date", "settlement_period"], ["dt", "ingested_at", "reading_id"])


def readings_to_profiles(raw: DataFrame, required: int = 48) -> DataFrame:
    """The pipeline over readings that have id and tariff; dedupe, day filter and packing share their partitioning by household and date."""
    days = complete_days(daily_readings(raw), ["household", "date"], "kwh", required)
    return pack(days, ["household", "tariff", "month_end", "month", "dayofweek", "day", "date"], "settlement_period", "kwh", "kwh")


def whole_profiles(raw: DataFrame, required: int = 48) -> DataFrame:
    """As readings_to_profiles, with the household of readings without id and the tariff of readings without one."""
    known = R.learn_files(raw)
    days = complete_days(daily_readings(raw, known), ["household", "date"], "kwh", required)
    tariffs = household_tariffs(clean_readings(raw, known))
    return pack_days(days, ["household", "month_end", "month", "dayofweek", "day", "date"], "settlement_period", "kwh", "kwh", tariffs)


def mean_std(df: DataFrame, value: str = "kwh") -> DataFrame:
    """Mean and population standard deviation over single readings."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))


def period(date_text: Column, strict_dates: bool = False) -> Column:
    """'historical', 'future' or null. Bounds compare as text, so the last day of a period only counts at no time of day; strict_dates takes it whole."""
    value = F.substring(date_text, 1, 10) if strict_dates else date_text
    out = F.lit(None).cast("string")
    for name, (lo, hi) in PERIODS.items():
        out = F.when(value.between(lo, hi), F.lit(name)).otherwise(out)
    return out


def four_way_split(readings: DataFrame, sample_size: int = 2000, seed: int = 0, strict_dates: bool = False) -> DataFrame:
    """Readings tagged with period and household_group, in one pass; rows of neither are dropped."""
    groups = household_groups(readings, "household", sample_size, seed)
    return readings.withColumn("period", period(F.col("date_text"), strict_dates)).where("period is not null").join(groups, "household")


def preprocess(raw: DataFrame, out_dir: str, sample_size: int = 2000, required: int = 48) -> None:
    """Split, preprocess and write the split readings, profiles and stats, partitioned by period and group instead of one run per file."""
    known = R.learn_files(raw) if "source_file" in raw.columns else None
    split = four_way_split(clean_readings(raw, known), sample_size).drop("dt")
    split.write.mode("overwrite").option("compression", "zstd").partitionBy("period", "household_group").parquet(f"{out_dir}/readings")
    df = daily_readings(raw, known)
    tagged = complete_days(four_way_split(df, sample_size), ["household", "date", "household_group"], "kwh", required)
    keys = ["period", "household_group", "household", "month_end", "month", "dayofweek", "day", "date"]
    P.write_profiles(pack_days(tagged, keys, "settlement_period", "kwh", "kwh", household_tariffs(clean_readings(raw, known))), f"{out_dir}/profiles", ["period", "household_group"])
    stats = tagged.groupBy("period", "household_group").agg(F.avg("kwh").alias("mean"), F.stddev_pop("kwh").alias("stdev"))
    stats.write.mode("overwrite").parquet(f"{out_dir}/stats")
