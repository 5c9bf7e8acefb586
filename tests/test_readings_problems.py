"""Completion, grid and spikes against brute force, and every dirty case of their inputs."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loadweave.operators import completion, grid, spikes
from loadweave.skew import heavy_keys

SCHEMA = "reading_id long, LCLid string, stdorToU string, DateTime string, kwh string, date date, month int, dayofweek int, settlement_period int, source_file string, ingested_at timestamp"
DAY = dt.datetime(2013, 3, 4)


def row(i, hh="MAC000001", tariff="Std", at=DAY, kwh="0.1", file=None, ing=0, text=None, dow=None):
    stamp = at.strftime("%Y-%m-%d %H:%M:%S") if at and text is None else text
    return (
        i, hh, tariff, stamp, kwh, at.date() if at else None, at.month if at else None,
        (at.weekday() if at else None) if dow is None else dow, None, file or f"f_{(hh or 'x').strip().upper()}", DAY + dt.timedelta(days=40, seconds=ing),
    )


def dirty(seed=1, households=4, n=400):
    rng = random.Random(seed)
    rows, i = [], 0
    for h in range(households):
        hh = f"MAC00000{h + 1}"
        t = DAY + dt.timedelta(minutes=rng.choice([0, 7]))
        value = "0.100"
        for _ in range(n):
            t += dt.timedelta(minutes=rng.choice([30, 30, 30, 30, 29, 31, 45, 15, 90]))
            if rng.random() < 0.6:
                value = f"{rng.choice([0.05, 0.1, 0.11, 0.2, 0.31]):.3f}"
            if rng.random() < 0.1:
                value = value
            kwh = rng.choice(["Null", None, " ", "NaN", "n/a"]) if rng.random() < 0.05 else rng.choice([value, value.replace(".", ","), f" {value} ", f"+{value}"])
            if rng.random() < 0.02:
                kwh = rng.choice(["-1", "12.5", "3.9", "999.999"])
            for _ in range(2 if rng.random() < 0.1 else 1):
                i += 1
                text = t.strftime(rng.choice(["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.0000000"]))
                name = rng.choice([hh, hh, hh.lower(), f" {hh} "]) if rng.random() > 0.03 else rng.choice([None, "", "UNKNOWN"])
                rows.append(row(i, name, rng.choice(["Std", "std", " Std", None, "?"]), t, kwh, file=f"f{h}", ing=rng.randrange(3), text=text, dow=rng.choice([None, 9, t.weekday()])))
    return rows


def number(s):
    try:
        v = float((s or "").strip().replace(",", "."))
    except ValueError:
        return None
    return v if v == v and abs(v) != float("inf") else None


def brute_spikes(rows):
    own = {r[9]: r[1].strip().upper() for r in rows if r[1] and r[1].strip().upper().startswith("MAC")}
    by = defaultdict(list)
    for r in rows:
        v = number(r[4])
        if v is not None:
            hh = r[1].strip().upper() if r[1] and r[1].strip().upper().startswith("MAC") else own.get(r[9])
            at = None if r[3] is None else dt.datetime.fromisoformat(r[3].replace("T", " ")[:19])
            by[hh].append((at, v, r[10], r[0]))
    out = set()
    for items in by.values():
        vs = sorted(v for _, v, _, _ in items)
        pos = 0.95 * (len(vs) - 1)
        lo = int(pos)
        level = vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (pos - lo)
        out |= {i for _, v, _, i in items if v < 0 or v > 11.5 or v > 4 * level}
        newest = {}
        for at, v, ing, i in items:
            if at and (at not in newest or (ing, i) > newest[at][1:]):
                newest[at] = (v, ing, i)
        times = sorted(newest)
        run = []
        for t in [*times, None]:
            if t is not None and run and newest[t][0] == newest[run[0]][0]:
                run.append(t)
                continue
            if len(run) >= 12 and newest[run[0]][0] > 0:
                ok = set(run)
                out |= {i for at, v, _, i in items if at in ok and v == newest[at][0]}
            run = [t]
    return out


def test_spikes_equal_brute_force(spark):
    rows = dirty()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_spikes(rows)
    assert want
    got = {r[0] for r in spikes.flag_spikes(df).select("reading_id").collect()}
    assert got == want
    split = {r[0] for r in spikes.flag_spikes(df, heavy_share=0.01, heavy_rows=10, bucket_rows=17).select("reading_id").collect()}
    assert split == want
    fine = {r[0] for r in spikes.flag_spikes(df, heavy_share=0.01, heavy_rows=10, bucket_rows=9, max_cuts=2).select("reading_id").collect()}
    assert fine == want


def test_tail_peaks_below_the_plain_rule_are_reported_on_request(spark):
    rng = random.Random(5)
    rows = [row(i, at=DAY + dt.timedelta(minutes=30 * i), kwh=f"{0.2 + 0.1 * rng.random():.4f}") for i in range(1, 481)]
    rows[240] = row(241, at=DAY + dt.timedelta(minutes=30 * 241), kwh="0.8")  # under 4 times the percentile
    df = spark.createDataFrame(rows, SCHEMA)
    assert spikes.flag_spikes(df).count() == 0
    got = {r["reading_id"]: r for r in spikes.flag_spikes(df, peaks=True).collect()}
    assert got[241]["reasons"] == ["tail"] and got[241]["kwh_value"] > got[241]["tail_cutoff"] and len(got) < 48
    dirty_df = spark.createDataFrame(dirty(), SCHEMA)
    plain = {r["reading_id"]: r["reasons"] for r in spikes.flag_spikes(dirty_df).collect()}
    peaks = {r["reading_id"]: [x for x in r["reasons"] if x != "tail"] for r in spikes.flag_spikes(dirty_df, peaks=True).collect()}
    assert {i: r for i, r in peaks.items() if r} == plain and len(peaks) > len(plain)


def test_the_tail_decides_spikes_and_no_limit_depends_on_the_split(spark):
    rng = random.Random(6)
    rows = [row(i, at=DAY + dt.timedelta(minutes=30 * i), kwh=f"{0.2 + 0.1 * rng.random():.4f}") for i in range(1, 481)]
    for i in range(30, 480, 40):
        rows[i] = row(i + 1, at=DAY + dt.timedelta(minutes=30 * (i + 1)), kwh=f"{1.5 + i / 100:.2f}")
    df = spark.createDataFrame(rows, SCHEMA)
    loose, strict = ({r[0] for r in spikes.flag_spikes(df, risk=x).select("reading_id").collect()} for x in (0.04, 1e-4))
    assert loose == set(range(31, 480, 40)) and strict < loose
    whole = {r["reading_id"]: r for r in spikes.flag_spikes(df, peaks=True).collect()}
    split = {r["reading_id"]: r for r in spikes.flag_spikes(df, peaks=True, heavy_share=0.01, heavy_rows=10, bucket_rows=17, max_cuts=5).collect()}
    assert whole.keys() == split.keys()
    for i, r in whole.items():
        assert r["tail_cutoff"] == pytest.approx(split[i]["tail_cutoff"]) and r["level"] == split[i]["level"] and r["reasons"] == split[i]["reasons"]


def test_stuck_run_across_cuts_and_reasons(spark):
    rows = [row(i, at=DAY + dt.timedelta(minutes=30 * i), kwh="0.5") for i in range(1, 41)] + [row(100, at=None, kwh="-3"), row(101, at=None, kwh="0.5")]
    df = spark.createDataFrame(rows, SCHEMA)
    for args in ({}, {"heavy_share": 0.01, "heavy_rows": 5, "bucket_rows": 3}, {"heavy_share": 0.01, "heavy_rows": 5, "bucket_rows": 2, "max_cuts": 1}):
        got = {r["reading_id"]: r["reasons"] for r in spikes.flag_spikes(df, **args).collect()}
        assert {i for i, r in got.items() if r == ["stuck"]} == set(range(1, 41)) and got[100] == ["impossible"] and 101 not in got


def test_completion_marks_and_values(spark):
    rows = dirty(seed=2)
    out = {r["reading_id"]: r for r in completion.complete_readings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    for r in rows:
        o = out[r[0]]
        marks = set()
        if number(r[4]) is None:
            marks.add("kwh")
        if r[7] is None or not 0 <= r[7] <= 6:
            marks.add("dayofweek")
        if (r[2] or "").strip().lower() not in ("std", "tou"):
            marks.add("stdorToU")
        if not (r[1] or "").strip().upper().startswith("MAC"):
            marks.add("LCLid")
        assert set(o["completed_fields"]) == marks
        assert o["household"] and o["tariff"] == "Std" and o["weekday"] == r[5].weekday() and o["kwh_value"] is not None
        assert ("kwh" in marks) == (o["kwh_from"] != "observed")


def test_completion_prefers_the_repeated_delivery(spark):
    rows = [row(1, kwh="0.7"), row(2, kwh="Null"), row(3, kwh="0.1", at=DAY + dt.timedelta(days=1)), row(4, kwh=None, at=DAY + dt.timedelta(days=2)), row(5, hh=None, tariff=None, at=None, kwh="x", file="lonely")]
    got = {r["reading_id"]: (r["kwh_value"], r["kwh_from"]) for r in completion.complete_readings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == (0.7, "fd:LCLid,DateTime") and got[4] == (pytest.approx(0.4), "group:LCLid,settlement_period") and got[5] == (None, "unfilled")


def test_completed_cells_come_through_the_dictionary_joins(spark):
    df = spark.createDataFrame(dirty(seed=4), SCHEMA)
    cells = completion.completed_cells(completion.complete_readings(df))
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") >= 7
    want = sum(len(r["completed_fields"]) for r in completion.complete_readings(df).collect())
    assert cells.count() == want > 0


def test_only_verified_dependencies_are_used(spark):
    rows = [row(i, hh=f"MAC00000{i % 3 + 1}", tariff=("Std", "ToU", "Std")[i % 3], at=DAY + dt.timedelta(hours=i), file=f"f{i % 2}") for i in range(60)]
    rows += [row(100, hh=None, tariff=None, at=DAY, file="f0"), row(101, hh="MAC000002", tariff=None, at=DAY, file="f0")]
    df = spark.createDataFrame(rows, SCHEMA)
    report = {(r["determinant"], r["dependent"]): r for r in completion.dependency_report(df).collect()}
    assert len(report) == 16 and report["LCLid", "stdorToU"]["confidence"] == 1.0 and report["source_file", "LCLid"]["confidence"] < 0.5
    got = {r["reading_id"]: r for r in completion.complete_readings(df).collect()}
    assert got[100]["household"] is None and got[100]["household_from"] == "unfilled" and got[100]["tariff_from"] == "unfilled"
    assert (got[101]["tariff"], got[101]["tariff_from"]) == ("ToU", "fd:LCLid")


def brute_holes(rows):
    own = {r[9]: r[1].strip().upper() for r in rows if r[1] and r[1].strip().upper().startswith("MAC")}
    seen = defaultdict(set)
    for r in rows:
        if r[3]:
            hh = r[1].strip().upper() if r[1] and r[1].strip().upper().startswith("MAC") else own.get(r[9])
            s = (dt.datetime.fromisoformat(r[3].replace("T", " ")[:19]) - dt.datetime(1970, 1, 1)).total_seconds()
            seen[hh].add(int((s + 900) // 1800))
    return {(h, s) for h, v in seen.items() for s in range(min(v), max(v)) if s not in v}


def test_grid_holes_equal_brute_force(spark):
    rows = dirty(seed=3)
    got = {(r["LCLid"], r["slot_date"], r["settlement_period"]) for r in grid.holes(grid.regular_grid(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = {(h, str((dt.datetime(1970, 1, 1) + dt.timedelta(seconds=1800 * s)).date()), s % 48 + 1) for h, s in brute_holes(rows)}
    assert got == want and want


def test_grid_interpolates_by_true_time_within_the_limit(spark):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    rows = [row(1, at=at(0), kwh="1"), row(2, at=at(100), kwh="3"), row(3, at=at(600), kwh="3"), row(4, at=at(614), kwh="4"), row(5, at=at(630), kwh="Null")]
    got = {r["settlement_period"]: (r["kwh"], r["is_hole"], r["fill"]) for r in grid.regular_grid(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (1.0, False, "observed") and got[2] == (pytest.approx(1.6), True, "interpolated")
    assert got[4] == (3.0, False, "observed") and got[10] == (None, True, "unfilled")
    assert got[21] == (4.0, False, "observed")  # two readings for one mark: the newest
    assert got[22] == (None, False, "unfilled") and len(got) == 22


def test_heavy_buckets_rise_with_time(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") * F.col("id")).alias("t"))
    for cuts in (3, 255):
        heavy = heavy_keys(df, "k", "t", 1000, least_rows=10, bucket_rows=50, max_cuts=cuts)
        rows = df.select("t", heavy.bucket(F.col("k"), F.col("t")).alias("b")).orderBy("t").collect()
        b = [r["b"] for r in rows]
        assert b == sorted(b) and 8 <= len(set(b)) <= heavy.most_buckets and max(b.count(x) for x in set(b)) <= 260
    assert heavy_keys(df, "k", "t", 1000).bounds == {} and heavy_keys(df.limit(0), "k", "t", 0, least_rows=0).bounds == {}


@pytest.mark.parametrize("op", ["complete", "grid", "spikes"])
def test_empty_null_and_clashing_inputs(spark, op):
    run = {"complete": completion.complete_readings, "grid": grid.regular_grid, "spikes": spikes.flag_spikes}[op]
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
    nulls = spark.createDataFrame([(1, *[None] * 10), (1, *[None] * 10)], SCHEMA)
    assert len(run(nulls).collect()) == (2 if op == "complete" else 0)
    extra = spark.createDataFrame([(*row(1), "mine", 3.0), (*row(1), "mine", 3.0)], SCHEMA + ", household string, KWH_value double")
    out = run(extra)
    assert len(out.collect()) == {"complete": 2, "grid": 1, "spikes": 0}[op]
    if op == "complete":
        assert {r["household_input"] for r in out.collect()} == {"mine"}
