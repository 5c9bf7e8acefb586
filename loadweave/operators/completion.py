"""Problem 1: complete missing values from readings of the same household, file or time.

Dependencies between columns are mined on the complete records: every column of file, household, tariff, date, month
and weekday is tried as determinant of household, tariff and weekday, and household with instant as determinant of
kwh. A dependency is used if its confidence (the share of records that have their key's main value) is verified; its
dictionary is left-joined to the incomplete rows, the most certain first. What no dictionary knows falls back to a
group (household and instant, household and half-hour of day, household, half-hour of day, all), and every value
carries where it came from.

The readings are counted once by those six columns (a household-day is a few rows, with map-side combine); report and
dictionaries both come from that written table. Only rows that lack something meet a join: complete rows pass in a
branch of their own. Dictionaries are broadcast up to a counted size; beyond it the joins carry no hints, so AQE may
split skewed keys.

Defined results: a value counts as missing as TESTDATA.md says (kwh that is no finite number, weekday outside 0-6,
tariff other than Std/ToU, id that is no household id). An empty table gives an empty result. Repeated rows give one
row each. Ties between equally frequent values go to the smallest value. Where nothing at all is known the value
stays null with provenance 'unfilled'. Input columns named like an output are kept as '<name>_input'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.functions import readings as R
from loadweave.functions.guard import set_aside
from loadweave.session import stage_table

OUTPUTS = ["household", "tariff", "weekday", "kwh_value", "household_from", "tariff_from", "weekday_from", "kwh_from", "completed_fields"]
#: columns that are tried as determinants, and those that can be completed from them
DETERMINANTS = {"source_file": "_lw_file", "LCLid": "_lw_hh", "stdorToU": "_lw_tariff", "date": "_lw_date", "month": "_lw_month", "dayofweek": "_lw_dow"}
DEPENDENTS = ("LCLid", "stdorToU", "dayofweek")
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Dependency:
    """determinant -> dependent, with the share of complete records that agree with their determinant's main value."""

    determinant: str
    dependent: str
    rows: int
    confidence: float
    keys: int = 0


@dataclass(frozen=True)
class Mined:
    """Written tables: _lw_pair, _lw_key, _lw_value, _lw_agree, _lw_all of every candidate, the instants of a household that matter, and its sums by half-hour."""

    dictionaries: DataFrame
    instants: DataFrame
    usual: DataFrame | None


def _parsed(readings: DataFrame) -> DataFrame:
    return readings.select(
        F.col("reading_id").alias("_lw_id"),
        R.household_id(F.col("LCLid")).alias("_lw_hh"),
        R.tariff(F.col("stdorToU")).alias("_lw_tariff"),
        R.weekday_number(F.col("dayofweek")).cast("int").alias("_lw_dow"),
        R.number(F.col("kwh")).alias("_lw_kwh"),
        R.epoch_seconds(F.col("DateTime")).alias("_lw_ts"),
        F.col("date").alias("_lw_date"),
        F.col("month").alias("_lw_month"),
        F.col("source_file").alias("_lw_file"),
    )


def mine(readings: DataFrame, groups: bool = True) -> Mined:
    """Count every candidate once. Rows written: keys of the candidates, instants with several deliveries or a lack, and with groups the half-hours of each household."""
    p = _parsed(readings)
    seen = p.groupBy(*DETERMINANTS.values()).agg(F.count("*").alias("_lw_n"))
    pairs = F.array(*[F.struct(F.lit(f"{a}>{b}").alias("p"), F.col(DETERMINANTS[a]).cast("string").alias("k"), F.col(DETERMINANTS[b]).cast("string").alias("v")) for b in DEPENDENTS for a in DETERMINANTS if a != b])
    counts = seen.select("_lw_n", F.explode(pairs).alias("x")).where("x.k is not null and x.v is not null")
    counts = counts.groupBy(F.col("x.p").alias("_lw_pair"), F.col("x.k").alias("_lw_key"), F.col("x.v").alias("_lw_value")).agg(F.sum("_lw_n").alias("_lw_c"))
    # min over (-count, value) is the most frequent value, ties to the smallest
    best = counts.groupBy("_lw_pair", "_lw_key").agg(F.min(F.struct((-F.col("_lw_c")).alias("c"), F.col("_lw_value").alias("v"))).alias("_lw_b"), F.sum("_lw_c").alias("_lw_all"))
    best = best.select("_lw_pair", "_lw_key", F.col("_lw_b.v").alias("_lw_value"), (-F.col("_lw_b.c")).alias("_lw_agree"), "_lw_all")
    at = p.where("_lw_hh is not null and _lw_ts is not null").groupBy("_lw_hh", "_lw_ts")
    at = at.agg(F.count("_lw_kwh").alias("_lw_n"), F.min("_lw_kwh").alias("_lw_lo"), F.max("_lw_kwh").alias("_lw_hi"), F.count("*").alias("_lw_rows"))
    at = at.where("_lw_n > 0 and (_lw_n > 1 or _lw_rows > _lw_n)").drop("_lw_rows")
    valued = p.where("_lw_kwh is not null and _lw_hh is not null").withColumn("_lw_sp", R.slot_period(R.nearest_slot(F.col("_lw_ts"))))
    usual = valued.groupBy("_lw_hh", "_lw_sp").agg(F.sum("_lw_kwh").alias("_lw_s"), F.count("*").alias("_lw_n"))
    return Mined(stage_table(best, "dictionaries"), stage_table(at, "instants"), stage_table(usual, "usual") if groups else None)


def _report(mined: Mined) -> DataFrame:
    measure = lambda agree, rows: (F.count("*").alias("n_keys"), F.coalesce(F.sum(rows), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum(agree), F.lit(0)).cast("long").alias("agree"))
    every = mined.dictionaries.sparkSession.createDataFrame([(a, b, f"{a}>{b}") for b in DEPENDENTS for a in DETERMINANTS if a != b], "determinant string, dependent string, _p string")
    per = mined.dictionaries.groupBy("_lw_pair").agg(*measure("_lw_agree", "_lw_all"))
    # as many rows as candidates
    out = every.join(F.broadcast(per), every["_p"] == per["_lw_pair"], "left").drop("_p", "_lw_pair").na.fill(0)
    repeated = mined.instants.where("_lw_n > 1").agg(*measure(F.when(F.col("_lw_lo") == F.col("_lw_hi"), F.col("_lw_n")).otherwise(0), F.col("_lw_n")))
    out = out.unionByName(repeated.select(F.lit("LCLid,DateTime").alias("determinant"), F.lit("kwh").alias("dependent"), "n_keys", "n_rows", "agree"))
    return out.select("determinant", "dependent", "n_keys", "n_rows", F.coalesce(F.try_divide("agree", "n_rows"), F.lit(0.0)).alias("confidence"))


def dependency_report(readings: DataFrame) -> DataFrame:
    """One row per candidate dependency: determinant, dependent, n_keys, n_rows, confidence.

    For kwh only instants with several deliveries count, and as agreeing those where all deliveries agree.
    """
    return _report(mine(readings, groups=False))


def mine_dependencies(mined: Mined) -> list[Dependency]:
    """The report as a list. The driver gets one row per candidate (16), whatever the data."""
    return [Dependency(r["determinant"], r["dependent"], r["n_rows"], r["confidence"], r["n_keys"]) for r in _report(mined).collect()]


def complete_readings(readings: DataFrame, min_confidence: float = 0.98, dependencies: list[Dependency] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every reading with its four fields completed and a mark on each completed value.

    Adds household, tariff, weekday, kwh_value, for each a *_from ('observed', 'fd:<determinant>', 'group:<group>',
    'unfilled'), and completed_fields, the names of the input columns that had to be completed.
    """
    mined = mine(readings)
    deps = dependencies if dependencies is not None else mine_dependencies(mined)
    src = set_aside(readings, OUTPUTS)

    def verified(dependent: str) -> list[Dependency]:
        """The most certain first, of equally certain ones that with the most records. A rule without any record is no rule."""
        ok = [d for d in deps if d.dependent == dependent and d.rows and d.confidence >= min_confidence]
        return sorted(ok, key=lambda d: (-d.confidence, -d.rows, d.determinant))

    own = (
        src.withColumn("_lw_hh", R.household_id(F.col("LCLid")))
        .withColumn("_lw_tariff", R.tariff(F.col("stdorToU")))
        .withColumn("_lw_dow", R.weekday_number(F.col("dayofweek")))
        .withColumn("_lw_kwh", R.number(F.col("kwh")))
    )
    lacking = F.col("_lw_hh").isNull() | F.col("_lw_tariff").isNull() | F.col("_lw_dow").isNull() | F.col("_lw_kwh").isNull()
    seen = F.lit("observed")
    whole = own.where(~lacking).select(
        *src.columns,
        F.col("_lw_hh").alias("household"),
        F.col("_lw_tariff").alias("tariff"),
        F.col("_lw_dow").cast("int").alias("weekday"),
        F.col("_lw_kwh").alias("kwh_value"),
        seen.alias("household_from"),
        seen.alias("tariff_from"),
        seen.alias("weekday_from"),
        seen.alias("kwh_from"),
        F.array().cast("array<string>").alias("completed_fields"),
    )

    part = own.where(lacking).withColumn("_lw_ts", R.epoch_seconds(F.col("DateTime")))
    part = part.withColumn("_lw_sp", R.slot_period(R.nearest_slot(F.col("_lw_ts"))))
    part = part.withColumn("_lw_file", F.col("source_file")).withColumn("_lw_date", F.col("date")).withColumn("_lw_month", F.col("month"))

    def learn(df: DataFrame, dictionary: DataFrame, keys: list[str], value: str, name: str, rows: int | None = None) -> DataFrame:
        d = dictionary.select(*[F.col(k).alias(f"_lw_k{i}") for i, k in enumerate(keys)], F.col(value).alias(name))
        cond = [F.col(k) == F.col(f"_lw_k{i}") for i, k in enumerate(keys)]
        return df.join(F.broadcast(d) if rows is not None and rows <= broadcast_rows else d, cond, "left").drop(*[f"_lw_k{i}" for i in range(len(keys))])

    def learn_rules(df: DataFrame, dependent: str) -> tuple[DataFrame, list[tuple[str, str]]]:
        """The verified dictionaries of a column, joined one by one; the household found so far is a determinant of the rest."""
        ways = []
        for i, d in enumerate(verified(dependent)):
            own = DETERMINANTS[d.determinant]
            words = mined.dictionaries.where(F.col("_lw_pair") == f"{d.determinant}>{dependent}").select(F.col("_lw_key").alias("_lw_word"), F.col("_lw_value").alias("_lw_is"))
            df = learn(df.withColumn("_lw_word_of", F.col(own).cast("string")), words.withColumnRenamed("_lw_word", "_lw_word_of"), ["_lw_word_of"], "_lw_is", f"_lw_r_{dependent}_{i}", d.keys)
            ways.append((f"_lw_r_{dependent}_{i}", f"fd:{d.determinant}"))
        return df.drop("_lw_word_of"), ways

    def first_of(*ways: tuple[str, str]) -> tuple:
        value = F.coalesce(*[F.col(c) for c, _ in ways])
        source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(w)) for c, w in ways], F.lit("unfilled"))
        return value, source

    part, hh_rules = learn_rules(part, "LCLid")
    hh, hh_from = first_of(("_lw_hh", "observed"), *hh_rules)
    part = part.withColumn("_lw_hh_from", hh_from).withColumn("_lw_hh", hh)
    part, tariff_rules = learn_rules(part, "stdorToU")
    part, dow_rules = learn_rules(part, "dayofweek")

    # kwh: the same household at the same instant (a repeated delivery), accepted only where all deliveries agree
    instant = mined.instants.where("_lw_lo = _lw_hi")
    usual = mined.usual
    mean = F.try_divide(F.sum("_lw_s"), F.sum("_lw_n"))
    part = learn(part, instant, ["_lw_hh", "_lw_ts"], "_lw_lo", "_lw_d_kwh")
    part = learn(part, usual.where("_lw_sp is not null").withColumn("_lw_m", F.try_divide("_lw_s", "_lw_n")), ["_lw_hh", "_lw_sp"], "_lw_m", "_lw_g1_kwh")
    part = learn(part, usual.groupBy("_lw_hh").agg(mean.alias("_lw_m")), ["_lw_hh"], "_lw_m", "_lw_g2_kwh")
    # the half-hours of a day: 48 rows by construction
    part = learn(part, F.broadcast(usual.where("_lw_sp is not null").groupBy("_lw_sp").agg(mean.alias("_lw_m"))), ["_lw_sp"], "_lw_m", "_lw_g3_kwh")

    repeats = "fd" if any(d.dependent == "kwh" and (not d.rows or d.confidence >= min_confidence) for d in deps) else "group"
    part = part.withColumn("_lw_c_dow", F.weekday(F.timestamp_seconds(F.col("_lw_ts"))).cast("string"))
    common = mined.dictionaries.where(F.col("_lw_pair") == "source_file>dayofweek")
    files = next((d.keys for d in deps if (d.determinant, d.dependent) == ("source_file", "dayofweek")), None)
    part = learn(part, common.select(F.col("_lw_key").alias("_lw_file"), "_lw_value"), ["_lw_file"], "_lw_value", "_lw_g_dow", files)
    part = part.withColumn("_lw_dow", F.col("_lw_dow").cast("string"))
    tariff, tariff_from = first_of(("_lw_tariff", "observed"), *tariff_rules)
    dow, dow_from = first_of(("_lw_dow", "observed"), *dow_rules, ("_lw_c_dow", "fd:DateTime"), ("_lw_g_dow", "group:source_file"))
    kwh, kwh_from = first_of(
        ("_lw_kwh", "observed"), ("_lw_d_kwh", f"{repeats}:LCLid,DateTime"), ("_lw_g1_kwh", "group:LCLid,settlement_period"), ("_lw_g2_kwh", "group:LCLid"), ("_lw_g3_kwh", "group:settlement_period")
    )
    marks = completed_marks(kwh_from, dow_from, tariff_from, F.col("_lw_hh_from"))
    part = part.select(
        *src.columns,
        F.col("_lw_hh").alias("household"),
        tariff.alias("tariff"),
        dow.cast("int").alias("weekday"),
        kwh.alias("kwh_value"),
        F.col("_lw_hh_from").alias("household_from"),
        tariff_from.alias("tariff_from"),
        dow_from.alias("weekday_from"),
        kwh_from.alias("kwh_from"),
        marks.alias("completed_fields"),
    )
    return whole.unionByName(part)


def completed_marks(kwh_from: Column, weekday_from: Column, tariff_from: Column, household_from: Column) -> Column:
    """Names of the fields whose provenance is not 'observed'."""
    return F.array_compact(F.array(*[F.when(c != "observed", F.lit(n)) for c, n in ((kwh_from, "kwh"), (weekday_from, "dayofweek"), (tariff_from, "stdorToU"), (household_from, "LCLid"))]))


def completed_cells(completed: DataFrame) -> DataFrame:
    """(reading_id, field_name): one row per value that was completed, by the provenance the fill left."""
    marks = completed_marks(F.col("kwh_from"), F.col("weekday_from"), F.col("tariff_from"), F.col("household_from"))
    return completed.select("reading_id", F.explode(marks).alias("field_name"))
