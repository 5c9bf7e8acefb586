"""Column expressions that give raw readings their meaning. All JVM-side and total: no input raises."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.session import stage_table

HOUSEHOLD_PATTERN = "^MAC[0-9]+$"
SLOT_SECONDS = 1800
SLOTS_PER_DAY = 48


def household_id(col: Column, pattern: str = HOUSEHOLD_PATTERN) -> Column:
    """Upper-cased, trimmed id; null where the text is no household id."""
    clean = F.upper(F.trim(col))
    return F.when(clean.rlike(pattern), clean)


def tariff(col: Column) -> Column:
    """'Std' or 'ToU' whatever the case and blanks; null otherwise."""
    clean = F.lower(F.trim(col))
    return F.when(clean == "std", F.lit("Std")).when(clean == "tou", F.lit("ToU"))


def weekday_number(col: Column) -> Column:
    """Monday 0 to Sunday 6; null where the number is no weekday."""
    return F.when(col.between(0, 6), col)


def number(col: Column) -> Column:
    """Text in any of the notations met (sign, padding, exponent, decimal comma) as a finite double, else null."""
    value = F.translate(F.trim(col), ",", ".")
    parsed = value.try_cast("double")
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)


def epoch_seconds(col: Column) -> Column:
    """Seconds since 1970 of an ISO text with blank or T, with or without fraction; null where it is none."""
    return F.unix_seconds(F.trim(col).try_cast("timestamp"))


def nearest_slot(seconds: Column) -> Column:
    """Half-hour mark nearest to a time, counted from 1970; midway goes to the later mark."""
    return F.floor((seconds + SLOT_SECONDS // 2) / SLOT_SECONDS).cast("long")


def slot_period(slot: Column) -> Column:
    """Settlement period 1..48 of a slot number: 00:00 is 1, 23:30 is 48."""
    return (F.pmod(slot, F.lit(SLOTS_PER_DAY)) + 1).cast("int")


def slot_date(slot: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(slot / SLOTS_PER_DAY).cast("int"))


def file_households(readings: DataFrame, id_col: str = "LCLid", file_col: str = "source_file", pattern: str = HOUSEHOLD_PATTERN, needed_only: bool = False) -> DataFrame:
    """(_lw_file, _lw_file_hh): the household named most often in a file, ties to the smallest id.

    One row per file (with needed_only: per file that has rows without id); built by partial aggregation, so what is
    shuffled is files times households per task.
    """
    # counted by the id as written, so that spellings are resolved once per group and not per row
    raw = readings.where(F.col(file_col).isNotNull()).groupBy(F.col(file_col).alias("_lw_file"), F.col(id_col).alias("_lw_raw")).agg(F.count("*").alias("_lw_n"))
    pairs = raw.groupBy("_lw_file", household_id(F.col("_lw_raw"), pattern).alias("_lw_hh")).agg(F.sum("_lw_n").alias("_lw_n"))
    # min over (-count, id) is the most frequent household
    best = F.min(F.when(F.col("_lw_hh").isNotNull(), F.struct((-F.col("_lw_n")).alias("n"), F.col("_lw_hh").alias("hh"))))
    files = pairs.groupBy("_lw_file").agg(best.alias("_lw_best"), F.max(F.col("_lw_hh").isNull()).alias("_lw_bare"))
    if needed_only:
        files = files.where("_lw_bare")
    return files.where("_lw_best is not null").select("_lw_file", F.col("_lw_best.hh").alias("_lw_file_hh"))


@dataclass(frozen=True)
class FileDictionary:
    """The needed part of the file dictionary as a written table, and its rows."""

    files: DataFrame
    rows: int


def learn_files(readings: DataFrame, id_col: str = "LCLid", file_col: str = "source_file", pattern: str = HOUSEHOLD_PATTERN) -> FileDictionary:
    """Build the dictionary once, written to the shared folder, for operators that resolve households several times."""
    files = stage_table(file_households(readings, id_col, file_col, pattern, needed_only=True), "files")
    return FileDictionary(files, files.count())


def with_household(readings: DataFrame, out: str, known: FileDictionary, id_col: str = "LCLid", file_col: str = "source_file", pattern: str = HOUSEHOLD_PATTERN, broadcast_rows: int = 50_000) -> DataFrame:
    """Add the household of each reading: its own id, or where that is missing the id of its file's other rows.

    A dictionary of up to `broadcast_rows` counted rows is broadcast and the readings are scanned once. Beyond that
    only rows without id meet a shuffled join, in a branch of their own, so neither a shuffle of the whole table nor
    a hot spot of null keys arises. Rows that stay without household keep null.
    """
    own = readings.withColumn(out, household_id(F.col(id_col), pattern))
    if known.rows <= broadcast_rows:
        key = F.when(F.col(out).isNull(), F.col(file_col))
        return own.join(F.broadcast(known.files), key == known.files["_lw_file"], "left").withColumn(out, F.coalesce(out, "_lw_file_hh")).drop("_lw_file", "_lw_file_hh")
    named = own.where(F.col(out).isNotNull())
    bare = own.where(F.col(out).isNull()).drop(out)
    found = bare.join(known.files, bare[file_col] == known.files["_lw_file"], "left").withColumn(out, F.col("_lw_file_hh")).drop("_lw_file", "_lw_file_hh")
    return named.unionByName(found)
