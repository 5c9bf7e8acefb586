"""Registered queries of the problems in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm import mixing, neighbours, overlap, packing, personal, quantiles, splits
from loadweave.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, d, "reconstruction_attack_dataset"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_samples(table(spark, d, "reconstruction_attack_dataset")).withColumn("distance", F.round("distance", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_households(table(spark, d, "household_register"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    shares = splits.split_shares(table(spark, d, "split_targets"))
    return splits.split_household_days(table(spark, d, "lcl_data"), table(spark, d, "household_register"), shares)


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    days = p4_splits(spark, d).groupBy("split").agg(F.count("*").alias("n_days"), F.countDistinct("LCLid").alias("n_households"))
    total = days.agg(F.sum("n_days").alias("_all"))
    targets = table(spark, d, "split_targets").select("split", "target_share")
    # one row of totals
    return targets.join(days, "split", "left").join(F.broadcast(total)).select("split", "target_share", F.coalesce("n_days", F.lit(0)).alias("n_days"), F.coalesce("n_households", F.lit(0)).alias("n_households"), F.try_divide("n_days", "_all").alias("share"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_pairs(table(spark, d, "lcl_profiles"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, d, "lcl_profiles"))


PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    days = quantiles.merge_days(quantiles.daily_summaries(table(spark, d, "lcl_data")))
    return quantiles.monthly_percentiles(days, PERCENTILES)


def _containers(spark: SparkSession, d: str) -> dict[str, int]:
    rows = table(spark, d, "container_sizes").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container classes")
    return {r["container"]: r["capacity_tokens"] for r in rows}


#: texts that machines wrote share no container with those of people
APART = ("model_note",)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return packing.pack(packing.cluster_near_copies(packing.sized_documents(documents), documents), _containers(spark, d), apart=APART)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(p8_containers(spark, d), _containers(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw_mix(packing.sized_documents(table(spark, d, "documents")), mixing.mix_plan(table(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mix(spark, d), mixing.mix_plan(table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_items(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_items(table(spark, d, "documents"), redacted=True)


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p4_found, p4_splits, p4_shares, p5_found, p5_counts, p7_percentiles, p8_containers, p8_fill, p9_mix, p9_shares, p10_found, p10_redacted)}

#: usable profiles and, by brute force, all pairs of a training and an evaluation profile that overlap
_OVERLAP = r"""
WITH u AS (SELECT profile_id AS id, lower(trim(split)) AS split, regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, kwh AS v FROM lcl_profiles
  WHERE lower(trim(split)) IN ('train', 'validation', 'test') AND len(kwh) = 48 AND NOT list_contains(list_transform(kwh, lambda x: x IS NULL OR NOT isfinite(x)), true) AND len(list_distinct(kwh)) >= 5),
o AS (SELECT t.id AS t, e.id AS e, t.v = e.v AS same FROM u t JOIN u e ON t.split = 'train' AND e.split <> 'train'
  WHERE list_sum(list_transform(list_zip(t.v, e.v), lambda z: CASE WHEN abs(z[1] - z[2]) <= 0.0055 + 1e-9 THEN 1 ELSE 0 END)) >= 44)"""

#: vectors that take part in problem 2
_VECTORS = "v AS (SELECT sample_id AS id, kwh AS v FROM reconstruction_attack_dataset WHERE len(kwh) = 48 AND NOT list_contains(list_transform(kwh, lambda x: x IS NULL OR NOT isfinite(x)), true))"

ORACLE = {
    # the true neighbours, which the query gives wherever it probes all lists, as it does up to 48 lists (24,000 vectors)
    "p2_neighbours": f"""WITH {_VECTORS}, r AS (SELECT a.id, b.id AS b, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d * d, 6), b) AS r FROM r)
SELECT id AS sample_id, b AS neighbour_id, CAST(r AS INTEGER) AS rank, round(d, 6) AS distance FROM k WHERE r <= 10""",
    "p2_found": f"""
WITH {_VECTORS},
n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
d AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d, least(a.n, b.n) AS n FROM n a JOIN n b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d * d, 6), b) AS r FROM d)
SELECT DISTINCT least(a, b) AS sample_id_a, greatest(a, b) AS sample_id_b FROM r WHERE r <= 10 AND d <= 0.1 * n * (1 + 1e-12)""",
    "p5_found": f"{_OVERLAP} SELECT least(t, e) AS profile_id_a, greatest(t, e) AS profile_id_b FROM o",
    "p5_counts": f"""{_OVERLAP},
k AS (SELECT e, count(*) AS n, max(same) AS exact FROM o GROUP BY e)
SELECT split, source, count(*) AS n_records, count(CASE WHEN exact THEN 1 END) AS n_exact, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
FROM u LEFT JOIN k ON u.id = k.e WHERE split <> 'train' GROUP BY split, source""",
    "p4_found": r"""
WITH RECURSIVE r AS (SELECT upper(trim(LCLid)) AS hh, upper(regexp_replace(meter_serial, '[^A-Za-z0-9]', '', 'g')) AS m,
  upper(regexp_replace(account_ref, '[^A-Za-z0-9]', '', 'g')) AS a, upper(trim(previous_lclid)) AS p FROM household_register),
e AS (SELECT x.hh AS a, y.hh AS b FROM r x JOIN r y ON x.m = y.m WHERE regexp_matches(x.m, '[1-9]')
  UNION SELECT x.hh, y.hh FROM r x JOIN r y ON x.a = y.a WHERE regexp_matches(x.a, '[1-9]')
  UNION SELECT hh, p FROM r WHERE p IN (SELECT hh FROM r) UNION SELECT p, hh FROM r WHERE p IN (SELECT hh FROM r)),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT a AS LCLid, min(b) AS group_lclid FROM c GROUP BY a HAVING count(DISTINCT b) > 1 OR min(b) <> a""",
}
