"""Problem 3: irregular readings onto a regular half-hour grid per household.

Readings are reduced to one per household and half-hour mark before anything is shuffled (a fast logger collapses
to its marks on the map side), so the window per household is bounded by time, not by rows. One window gives each
mark its neighbours on both sides: an as-of merge of the sorted grid with the sorted readings. Holes up to the gap
limit are interpolated linearly, weighted by the readings' true times; longer ones stay marked.

Defined results: a row stands for the mark nearest its time, midway for the later one; rows without time or
household stand for none. Of several rows for a mark the newest with a value gives it (ingested_at, then reading_id).
A household with one reading gives one row; an empty table an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadweave.functions import readings as R


def regular_grid(readings: DataFrame, gap_limit: int = 6) -> DataFrame:
    """One row per household and half-hour from its first to its last reading.

    household, slot_date, settlement_period, kwh, is_hole (no row stands for the mark), fill: 'observed',
    'interpolated' or 'unfilled' (no neighbour on one side, or more than gap_limit marks without value).
    """
    rows = R.with_household(readings.select("LCLid", "source_file", "DateTime", "kwh", "ingested_at", "reading_id"), "_lw_hh", R.learn_files(readings))
    rows = rows.select(
        "_lw_hh", R.epoch_seconds(F.col("DateTime")).alias("_lw_ts"), R.number(F.col("kwh")).alias("_lw_kwh"), F.col("ingested_at").alias("_lw_ing"), F.col("reading_id").alias("_lw_id")
    ).withColumn("_lw_slot", R.nearest_slot(F.col("_lw_ts")))
    rows = rows.where("_lw_hh is not null and _lw_slot is not null")
    newest = F.max(F.when(F.col("_lw_kwh").isNotNull(), F.struct("_lw_ing", "_lw_id", "_lw_kwh", "_lw_ts")))
    marks = rows.groupBy("_lw_hh", "_lw_slot").agg(newest.alias("_lw_best"))
    marks = marks.select("_lw_hh", "_lw_slot", F.when(F.col("_lw_best").isNotNull(), F.struct(F.col("_lw_slot").alias("slot"), F.col("_lw_best._lw_ts").alias("ts"), F.col("_lw_best._lw_kwh").alias("kwh"))).alias("_lw_val"))

    w = Window.partitionBy("_lw_hh").orderBy("_lw_slot")
    marks = marks.select(
        "_lw_hh",
        "_lw_slot",
        F.lead("_lw_slot").over(w).alias("_lw_next"),
        F.last("_lw_val", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_lw_before"),
        F.expr("lead(_lw_val) IGNORE NULLS OVER (PARTITION BY _lw_hh ORDER BY _lw_slot)").alias("_lw_after"),
    )
    grid = marks.withColumn("_lw_at", F.explode(F.sequence(F.col("_lw_slot"), F.coalesce(F.col("_lw_next") - 1, F.col("_lw_slot")))))
    observed = F.coalesce(F.col("_lw_before.slot") == F.col("_lw_at"), F.lit(False))
    span = F.col("_lw_after.slot") - F.col("_lw_before.slot") - 1
    share = F.try_divide(F.col("_lw_at") * R.SLOT_SECONDS - F.col("_lw_before.ts"), F.col("_lw_after.ts") - F.col("_lw_before.ts"))
    between = F.col("_lw_before.kwh") + (F.col("_lw_after.kwh") - F.col("_lw_before.kwh")) * share
    fillable = ~observed & (span <= gap_limit) & share.isNotNull()
    return grid.select(
        F.col("_lw_hh").alias("household"),
        R.slot_date(F.col("_lw_at")).alias("slot_date"),
        R.slot_period(F.col("_lw_at")).alias("settlement_period"),
        F.when(observed, F.col("_lw_before.kwh")).when(fillable, between).alias("kwh"),
        (F.col("_lw_at") != F.col("_lw_slot")).alias("is_hole"),
        F.when(observed, F.lit("observed")).when(fillable, F.lit("interpolated")).otherwise(F.lit("unfilled")).alias("fill"),
    )


def holes(grid: DataFrame) -> DataFrame:
    """Marks that no row stands for, by the fill the merge of grid and readings left: a mark without row is never observed."""
    return grid.where("is_hole and fill <> 'observed'").select(F.col("household").alias("LCLid"), F.date_format("slot_date", "yyyy-MM-dd").alias("slot_date"), "settlement_period")
