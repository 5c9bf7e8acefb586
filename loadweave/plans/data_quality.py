"""Queries of the general problems 1, 3 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.operators import completion, grid, spikes
from loadweave.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return completion.completed_cells(completion.complete_readings(table(spark, d, "lcl_data")))


def p1_completed(spark: SparkSession, d: str) -> DataFrame:
    out = completion.complete_readings(table(spark, d, "lcl_data"))
    return out.select("reading_id", "household", "tariff", "weekday", F.round("kwh_value", 9).alias("kwh_value"), "household_from", "tariff_from", "weekday_from", "kwh_from")


def p1_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return completion.dependency_report(table(spark, d, "lcl_data"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.holes(grid.regular_grid(table(spark, d, "lcl_data")))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "lcl_data")).withColumn("kwh", F.round("kwh", 9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_spikes(table(spark, d, "lcl_data")).select("reading_id")


def p6_flagged(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_spikes(table(spark, d, "lcl_data"), peaks=True)


_NUMBER = "try_cast(replace(trim(kwh), ',', '.') AS DOUBLE)"
_TS = "try_cast(replace(trim(DateTime), 'T', ' ') AS TIMESTAMP)"
_HH = """
files AS (SELECT source_file, min(hh) AS fhh FROM (SELECT source_file, upper(trim(LCLid)) AS hh FROM lcl_data WHERE regexp_matches(upper(trim(LCLid)), '^MAC[0-9]+$')) GROUP BY 1),
r AS (SELECT l.reading_id, l.ingested_at, CASE WHEN regexp_matches(upper(trim(l.LCLid)), '^MAC[0-9]+$') THEN upper(trim(l.LCLid)) ELSE f.fhh END AS hh,
  CASE WHEN isfinite({number}) THEN {number} END AS v, {ts} AS ts
  FROM lcl_data l LEFT JOIN files f ON l.source_file = f.source_file)""".format(number=_NUMBER, ts=_TS)

#: readings as problem 1 sees them, and every candidate dependency with the main value of each key
_COLUMNS = {"source_file": "f", "LCLid": "hh", "stdorToU": "t", "date": "CAST(d AS VARCHAR)", "month": "CAST(m AS VARCHAR)", "dayofweek": "CAST(w AS VARCHAR)"}
_FILLED = ("LCLid", "stdorToU", "dayofweek")
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_COLUMNS[a]} AS k, {_COLUMNS[b]} AS v, count(*) AS c FROM p WHERE {_COLUMNS[a]} IS NOT NULL AND {_COLUMNS[b]} IS NOT NULL GROUP BY 1, 2, 3, 4" for b in _FILLED for a in _COLUMNS if a != b)
_MINED = f"""
p AS (SELECT reading_id, source_file AS f, CASE WHEN regexp_matches(upper(trim(LCLid)), '^MAC[0-9]+$') THEN upper(trim(LCLid)) END AS hh, CASE lower(trim(stdorToU)) WHEN 'std' THEN 'Std' WHEN 'tou' THEN 'ToU' END AS t,
  CASE WHEN dayofweek BETWEEN 0 AND 6 THEN dayofweek END AS w, CASE WHEN isfinite({_NUMBER}) THEN {_NUMBER} END AS v, {_TS} AS ts, date AS d, month AS m FROM lcl_data),
dict AS (SELECT a, b, k, v, c AS agree, n FROM (SELECT *, sum(c) OVER (PARTITION BY a, b, k) AS n, row_number() OVER (PARTITION BY a, b, k ORDER BY c DESC, v) AS rn FROM ({_PAIRS})) WHERE rn = 1),
inst AS (SELECT hh, ts, count(v) AS n, min(v) AS lo, max(v) AS hi FROM p WHERE hh IS NOT NULL AND ts IS NOT NULL GROUP BY hh, ts HAVING count(v) > 0),
report AS (SELECT a, b, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, sum(agree) / sum(n) AS confidence FROM dict GROUP BY a, b
  UNION ALL SELECT 'LCLid,DateTime', 'kwh', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), coalesce(sum(CASE WHEN lo = hi THEN n ELSE 0 END) / sum(n), 0) FROM inst WHERE n > 1)"""


def _fill(name: str, field: str, lack: str, rows: str) -> str:
    """The value of the most certain verified dependency that knows the row's key."""
    keys = " UNION ALL ".join(f"SELECT reading_id, '{a}' AS a, {c} AS k FROM {rows} WHERE {lack} IS NULL" for a, c in _COLUMNS.items() if a != field)
    return f"{name} AS (SELECT reading_id, arg_min(v, rk) AS v, arg_min(a, rk) AS a FROM ({keys}) x JOIN dict USING (a, k) JOIN ok USING (a, b) WHERE b = '{field}' GROUP BY reading_id)"


ORACLE = {
    "p1_dependencies": f"WITH {_MINED} SELECT a AS determinant, b AS dependent, n_keys, n_rows, confidence FROM report",
    "p1_completed": f"""WITH {_MINED},
ok AS (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY confidence DESC, n_rows DESC, a) AS rk FROM report WHERE confidence >= 0.98 AND b <> 'kwh'),
{_fill("hf", "LCLid", "hh", "p")},
q AS (SELECT p.* EXCLUDE (hh), coalesce(hh, hf.v) AS hh, CASE WHEN hh IS NOT NULL THEN 'observed' ELSE coalesce('fd:' || hf.a, 'unfilled') END AS hh_from, CAST(floor((epoch(ts) + 900) / 1800) AS BIGINT) % 48 + 1 AS sp FROM p LEFT JOIN hf USING (reading_id)),
{_fill("tf", "stdorToU", "t", "q")},
{_fill("wf", "dayofweek", "w", "q")},
us AS (SELECT hh, CAST(floor((epoch(ts) + 900) / 1800) AS BIGINT) % 48 + 1 AS sp, sum(v) AS s, count(*) AS n FROM p WHERE v IS NOT NULL AND hh IS NOT NULL GROUP BY 1, 2),
g2 AS (SELECT hh, sum(s) / sum(n) AS x FROM us GROUP BY hh), g3 AS (SELECT sp, sum(s) / sum(n) AS x FROM us WHERE sp IS NOT NULL GROUP BY sp),
kind AS (SELECT CASE WHEN n_rows = 0 OR confidence >= 0.98 THEN 'fd' ELSE 'group' END AS x FROM report WHERE b = 'kwh')
SELECT q.reading_id, q.hh AS household, coalesce(t, tf.v) AS tariff, CAST(coalesce(CAST(w AS INTEGER), CAST(wf.v AS INTEGER), isodow(q.ts) - 1, CAST(wd.v AS INTEGER)) AS INTEGER) AS weekday,
  round(coalesce(q.v, i.lo, us.s / us.n, g2.x, g3.x), 9) AS kwh_value, hh_from AS household_from,
  CASE WHEN t IS NOT NULL THEN 'observed' ELSE coalesce('fd:' || tf.a, 'unfilled') END AS tariff_from,
  CASE WHEN w IS NOT NULL THEN 'observed' WHEN wf.a IS NOT NULL THEN 'fd:' || wf.a WHEN q.ts IS NOT NULL THEN 'fd:DateTime' WHEN wd.v IS NOT NULL THEN 'group:source_file' ELSE 'unfilled' END AS weekday_from,
  CASE WHEN q.v IS NOT NULL THEN 'observed' WHEN i.lo IS NOT NULL THEN kind.x || ':LCLid,DateTime' WHEN us.s IS NOT NULL THEN 'group:LCLid,settlement_period' WHEN g2.x IS NOT NULL THEN 'group:LCLid' WHEN g3.x IS NOT NULL THEN 'group:settlement_period' ELSE 'unfilled' END AS kwh_from
FROM q LEFT JOIN tf USING (reading_id) LEFT JOIN wf USING (reading_id) LEFT JOIN dict wd ON wd.a = 'source_file' AND wd.b = 'dayofweek' AND wd.k = q.f
LEFT JOIN inst i ON i.hh = q.hh AND i.ts = q.ts AND i.lo = i.hi LEFT JOIN us ON us.hh = q.hh AND us.sp = q.sp LEFT JOIN g2 ON g2.hh = q.hh LEFT JOIN g3 ON g3.sp = q.sp, kind""",
    "p1_found": f"""
SELECT reading_id, 'kwh' AS field_name FROM lcl_data WHERE {_NUMBER} IS NULL OR NOT isfinite({_NUMBER})
UNION ALL SELECT reading_id, 'dayofweek' FROM lcl_data WHERE dayofweek IS NULL OR dayofweek NOT BETWEEN 0 AND 6
UNION ALL SELECT reading_id, 'stdorToU' FROM lcl_data WHERE stdorToU IS NULL OR lower(trim(stdorToU)) NOT IN ('std', 'tou')
UNION ALL SELECT reading_id, 'LCLid' FROM lcl_data WHERE LCLid IS NULL OR NOT regexp_matches(upper(trim(LCLid)), '^MAC[0-9]+$')""",
    "p3_found": f"""
WITH {_HH},
s AS (SELECT DISTINCT hh, CAST(floor((epoch(ts) + 900) / 1800) AS BIGINT) AS slot FROM r WHERE ts IS NOT NULL AND hh IS NOT NULL),
b AS (SELECT hh, min(slot) AS lo, max(slot) AS hi FROM s GROUP BY hh),
g AS (SELECT hh, unnest(range(lo, hi + 1)) AS slot FROM b)
SELECT g.hh AS LCLid, strftime(DATE '1970-01-01' + CAST(g.slot // 48 AS INTEGER), '%Y-%m-%d') AS slot_date, CAST(g.slot % 48 + 1 AS INTEGER) AS settlement_period
FROM g ANTI JOIN s ON g.hh = s.hh AND g.slot = s.slot""",
    "p3_grid": f"""
WITH {_HH},
s AS (SELECT hh, CAST(floor((epoch(ts) + 900) / 1800) AS BIGINT) AS slot, floor(epoch(ts)) AS sec, v, ingested_at, reading_id FROM r WHERE ts IS NOT NULL AND hh IS NOT NULL),
m AS (SELECT DISTINCT hh, slot FROM s),
b AS (SELECT hh, slot, sec, v FROM (SELECT *, row_number() OVER (PARTITION BY hh, slot ORDER BY ingested_at DESC NULLS LAST, reading_id DESC) AS rn FROM s WHERE v IS NOT NULL) WHERE rn = 1),
g AS (SELECT hh, unnest(range(lo, hi + 1)) AS slot FROM (SELECT hh, min(slot) AS lo, max(slot) AS hi FROM m GROUP BY hh)),
f AS (SELECT g.hh, g.slot, m.slot IS NULL AS is_hole, b.v, last_value(b.slot IGNORE NULLS) OVER p AS s0, last_value(b.sec IGNORE NULLS) OVER p AS t0, last_value(b.v IGNORE NULLS) OVER p AS v0,
  first_value(b.slot IGNORE NULLS) OVER n AS s1, first_value(b.sec IGNORE NULLS) OVER n AS t1, first_value(b.v IGNORE NULLS) OVER n AS v1
  FROM g LEFT JOIN m ON m.hh = g.hh AND m.slot = g.slot LEFT JOIN b ON b.hh = g.hh AND b.slot = g.slot
  WINDOW p AS (PARTITION BY g.hh ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY g.hh ORDER BY g.slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, v IS NULL AND s1 - s0 - 1 <= 6 AND t1 <> t0 AS fills FROM f)
SELECT hh AS household, CAST(DATE '1970-01-01' + CAST(slot // 48 AS INTEGER) AS DATE) AS slot_date, CAST(slot % 48 + 1 AS INTEGER) AS settlement_period, is_hole,
  round(CASE WHEN v IS NOT NULL THEN v WHEN fills THEN v0 + (v1 - v0) * ((slot * 1800 - t0) / (t1 - t0)) END, 9) AS kwh,
  CASE WHEN v IS NOT NULL THEN 'observed' WHEN fills THEN 'interpolated' ELSE 'unfilled' END AS fill FROM k""",
    "p6_found": f"""
WITH {_HH},
lv AS (SELECT hh, quantile_cont(v, 0.95) AS p FROM r WHERE v IS NOT NULL GROUP BY hh),
o AS (SELECT *, row_number() OVER (PARTITION BY hh, ts ORDER BY ingested_at DESC, reading_id DESC) AS rn FROM r WHERE v IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT hh, ts, v, CASE WHEN v = lag(v) OVER (PARTITION BY hh ORDER BY ts) THEN 0 ELSE 1 END AS st FROM o WHERE rn = 1),
g AS (SELECT *, sum(st) OVER (PARTITION BY hh ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM n),
k AS (SELECT *, count(*) OVER (PARTITION BY hh, run) AS len FROM g)
SELECT reading_id FROM r LEFT JOIN lv ON r.hh IS NOT DISTINCT FROM lv.hh WHERE v IS NOT NULL AND (v < 0 OR v > 11.5 OR v > 4 * lv.p)
UNION SELECT o.reading_id FROM o JOIN k ON o.hh IS NOT DISTINCT FROM k.hh AND o.ts = k.ts AND o.v = k.v WHERE k.len >= 12 AND k.v > 0""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_completed, p1_dependencies, p3_found, p3_grid, p6_found, p6_flagged)}
