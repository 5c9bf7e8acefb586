"""Problem 5: the same or nearly the same profile in the training split and in an evaluation split.

Profiles are canonicalised and hashed; exact copies within a side collapse to one representative before anything is
compared. Two profiles that agree within `tolerance` in all but m = 48 - least half-hours agree fully in at least one
of m + 1 interleaved bands (pigeonhole), so every band is hashed over a grid of cells: a training profile has one
hash per band, an evaluation profile one for each combination of cells its values may fall in after a shift by the
tolerance. Every hash carries its band's values, which are compared inside the join, so the equi-join of evaluation
hashes with training hashes emits only pairs that agree in a whole band, however many profiles share a cell. It misses
nothing; its candidates are compared exactly. No cap is set on partners; a hot hash is an ordinary skewed join key
that AQE splits.

Defined results: only profiles with 48 non-null finite values, at least five different, take part; a profile in
neither train, validation nor test takes no part. Copies give all their pairs, as the case list demands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.session import stage_table

WIDTH = 48
SLACK = 1e-9


def canonical_source(col: Column) -> Column:
    """A source whatever its case, blanks, '-' or '_'."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_]+", "_")


def _finite(v: Column) -> Column:
    return F.coalesce(F.size(v) == WIDTH, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable_profiles(profiles: DataFrame, least_values: int = 5) -> DataFrame:
    """_id, _side ('train' or 'eval'), _split, _source, _v, and the 128-bit record hash _k1, _k2."""
    split = F.lower(F.trim(F.col("split")))
    p = profiles.select(F.col("profile_id").alias("_id"), split.alias("_split"), canonical_source(F.col("source")).alias("_source"), F.col("kwh").alias("_v"))
    p = p.where(F.col("_split").isin("train", "validation", "test") & _finite(F.col("_v")) & (F.size(F.array_distinct("_v")) >= least_values))
    side = F.when(F.col("_split") == "train", F.lit("train")).otherwise(F.lit("eval"))
    return p.select("_id", side.alias("_side"), "_split", "_source", "_v", F.xxhash64(F.lit(1), "_v").alias("_k1"), F.xxhash64("_v", F.lit(2)).alias("_k2"))


def _bands(misses: int) -> list[list[int]]:
    return [list(range(b, WIDTH, misses + 1)) for b in range(misses + 1)]


def banded(v: Column, misses: int, tolerance: float, cell: float, probes: bool) -> Column:
    """array<struct<hashes, values>>, one per band: its hash, or with probes all hashes a profile within tolerance may have, and its values."""
    reach = tolerance + SLACK if probes else 0.0

    def shift(i: int) -> float:
        return cell * ((i * 0.6180339887) % 1.0)

    def of(b: int, at: list[int]) -> Column:
        cells = F.array(*[F.struct(F.floor((v[i] - reach + shift(i)) / cell).alias("lo"), F.floor((v[i] + reach + shift(i)) / cell).alias("hi")) for i in at])
        start = F.array(F.lit(b).cast("long"))
        step = lambda acc, c: F.when(
            c["lo"] == c["hi"], F.transform(acc, lambda h: F.xxhash64(h, c["lo"]))
        ).otherwise(F.concat(F.transform(acc, lambda h: F.xxhash64(h, c["lo"])), F.transform(acc, lambda h: F.xxhash64(h, c["hi"]))))
        return F.struct(F.aggregate(cells, start, step).alias("hashes"), F.array(*[v[i] for i in at]).cast("array<float>").alias("values"))

    return F.array(*[of(b, at) for b, at in enumerate(_bands(misses))])


def _band_agrees(misses: int, tolerance: float) -> Column:
    """The values of the band agree one by one; tested inside the join, so what fails never becomes a row."""
    out = F.lit(True)
    for i in range(max(len(at) for at in _bands(misses))):
        a, b = F.get(F.col("_tb"), F.lit(i)).cast("double"), F.get(F.col("_eb"), F.lit(i)).cast("double")
        # the slack covers what single precision rounds away; a shorter band has no such value, and huge values may
        # have become infinite: neither may exclude a pair
        out = out & F.coalesce((F.abs(a - b) <= tolerance + SLACK + F.lit(2e-7) * F.abs(a)) | F.isnan(a - b), F.lit(True))
    return out


def overlap_candidates(p: DataFrame, tolerance: float = 0.0055, least: int = 44, cell: float = 0.06) -> DataFrame:
    """(_t, _e), distinct: every pair of records that may overlap; p as from usable_profiles, one row per record."""
    if cell <= 2 * (tolerance + SLACK):
        raise ValueError("a cell must be wider than twice the tolerance")
    misses = WIDTH - least

    def rows(side: str, name: str, probes: bool) -> DataFrame:
        own = p.where(F.col("_side") == side).select(F.col("_id").alias(f"_{name}"), F.explode(banded(F.col("_v"), misses, tolerance, cell, probes)).alias("_b"))
        return own.select(f"_{name}", F.explode("_b.hashes").alias("_h"), F.col("_b.values").alias(f"_{name}b"))

    return rows("train", "t", False).join(rows("eval", "e", True), "_h").where(_band_agrees(misses, tolerance)).select("_t", "_e").distinct()


@dataclass(frozen=True)
class Records:
    """Written tables: all usable records, and (_id, _rep, _side) of those whose record is not the only one like it on its side."""

    all: DataFrame
    copies: DataFrame

    def representatives(self) -> DataFrame:
        """The record of least id of every class. Only ids move, and they are broadcast up to a counted size."""
        return self.all.join(small(self.copies.where("_id <> _rep").select("_id")), "_id", "left_anti")

    def members(self, rep: str, out: str) -> DataFrame:
        """Ids of the copies of each representative, for a left join: who has none stands for itself."""
        return small(self.copies.select(F.col("_rep").alias(rep), F.col("_id").alias(out)))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A table of ids from written ones, broadcast up to a counted size."""
    return F.broadcast(df) if df.count() <= rows else df


def records(profiles: DataFrame) -> Records:
    p = stage_table(usable_profiles(profiles), "profiles")
    hashed = p.select("_id", "_side", "_k1", "_k2")
    several = hashed.groupBy("_side", "_k1", "_k2").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return Records(p, stage_table(hashed.join(several, ["_side", "_k1", "_k2"]).select("_id", "_rep", "_side"), "copies"))


def overlap_classes(r: Records, tolerance: float = 0.0055, least: int = 44, cell: float = 0.06) -> DataFrame:
    """(_t, _e, _same): representatives of training and evaluation records that overlap."""
    first = r.representatives()
    candidates = stage_table(overlap_candidates(first, tolerance, least, cell), "candidates")
    # only profiles that have a candidate are moved
    needed = small(candidates.select(F.explode(F.array("_t", "_e")).alias("_id")).distinct())
    values = r.all.select("_id", "_v").join(needed, "_id", "left_semi")
    pairs = candidates.join(values.select(F.col("_id").alias("_t"), F.col("_v").alias("_tv")), "_t").join(values.select(F.col("_id").alias("_e"), F.col("_v").alias("_ev")), "_e")
    near = F.aggregate(F.zip_with("_tv", "_ev", lambda a, b: F.when(F.abs(a - b) <= tolerance + SLACK, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return pairs.where(near >= least).select("_t", "_e", (F.col("_tv") == F.col("_ev")).alias("_same"))


def overlapping_pairs(profiles: DataFrame, tolerance: float = 0.0055, least: int = 44) -> DataFrame:
    """profile_id_a < profile_id_b: every pair of a training and an evaluation profile that overlap."""
    r = records(profiles)
    out = overlap_classes(r, tolerance, least).join(r.members("_t", "_tm"), "_t", "left").join(r.members("_e", "_em"), "_e", "left")
    out = out.select(F.coalesce("_tm", "_t").alias("_ti"), F.coalesce("_em", "_e").alias("_ei"))
    return out.select(F.least("_ti", "_ei").alias("profile_id_a"), F.greatest("_ti", "_ei").alias("profile_id_b"))


def overlap_counts(profiles: DataFrame, tolerance: float = 0.0055, least: int = 44) -> DataFrame:
    """Per evaluation split and source: usable records, records with an exact and with any overlap, and pairs."""
    r = records(profiles)
    sizes = r.copies.groupBy(F.col("_rep").alias("_t")).agg(F.count("*").alias("_n"))
    per = overlap_classes(r, tolerance, least).join(sizes, "_t", "left").groupBy("_e").agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_pairs"), F.max(F.col("_same").cast("int")).alias("_exact"))
    own = r.all.where("_side = 'eval'").select("_id", "_split", "_source").join(small(r.copies.select("_id", "_rep")), "_id", "left").withColumn("_e", F.coalesce("_rep", "_id"))
    return own.join(per, "_e", "left").groupBy(F.col("_split").alias("split"), F.col("_source").alias("source")).agg(
        F.count("*").alias("n_records"),
        F.coalesce(F.sum("_exact"), F.lit(0)).cast("long").alias("n_exact"),
        F.count("_pairs").alias("n_overlapping"),
        F.coalesce(F.sum("_pairs"), F.lit(0)).cast("long").alias("n_pairs"),
    )
