"""Nulls in any column, empty tables, repeated rows and clashing column names for every operator of the subpackage."""

import pytest
from pyspark.sql import functions as F

from loadweave.llm import mixing, neighbours, overlap, packing, personal, quantiles, splits

CASES = {
    "neighbours": ("sample_id long, kwh array<double>, _id string, _v int, _class int", lambda df: neighbours.close_pairs(df, width=2, k=2), [(1, [1.0, 2.0], "x", 1, 1), (2, [1.0, 2.0], "x", 1, 1)], [(1, 2)]),
    "splits": ("LCLid string, meter_serial string, account_ref string, previous_lclid string, _node string, _hh int", splits.linked_households, [("MAC000001", "A1", None, None, "x", 1), ("mac000002", "a-1", None, None, "x", 1)], [("MAC000001", "MAC000001"), ("MAC000002", "MAC000001")]),
    "overlap": ("profile_id long, kwh array<double>, source string, split string, _id string, _side int", overlap.overlapping_pairs, [(1, [float(i % 9) for i in range(48)], "a", "train", "x", 1), (2, [float(i % 9) for i in range(48)], "a", "test", "x", 1)], [(1, 2)]),
    "quantiles": (
        "LCLid string, source_file string, month int, date date, kwh string, household string, levels int",
        lambda df: quantiles.monthly_percentiles(quantiles.merge_days(quantiles.daily_summaries(df)), [0.5]).select("household", "month", "n", "value"),
        [("MAC000001", "f", 1, None, "0.3", "x", 1)], [],
    ),
    "packing": ("doc_id long, text string, source string, container string, _tokens int", lambda df: packing.pack(packing.sized_documents(df), {"c": 8}).select("doc_id", "piece", "n_tokens"), [(1, "meter", "s", "x", 1)], [(1, 0, 1)]),
    "mixing": ("doc_id long, text string, source string, n_tokens int, repeat int", lambda df: mixing.draw_mix(packing.sized_documents(df), {"s": (1.0, 1)}).select("doc_id", "source", "repeat"), [(1, "meter", " S", 1, 1)], [(1, "s", 1)]),
    "personal": ("doc_id long, text string, pii_type string, pii_text string", lambda df: personal.personal_items(df), [(1, "x@y.test", "x", "x")], [(1, "email", "x@y.test")]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_edges(spark, name):
    schema, run, rows, want = CASES[name]
    width = len(schema.split(", "))
    assert run(spark.createDataFrame([], schema)).collect() == []
    nulls = run(spark.createDataFrame([tuple([None] * width)] * 3, schema)).collect()
    assert len(nulls) == (3 if name == "packing" else 0)
    got = sorted(tuple(r) for r in run(spark.createDataFrame(rows, schema)).collect())
    assert got == want


def test_hot_group_of_copies(spark):
    """A third of all rows are copies of one vector, one profile and one text: results stay whole."""
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [float(i), 1.0]) for i in range(300)]
    pairs = neighbours.close_pairs(spark.createDataFrame(rows, "sample_id long, kwh array<double>"), width=2, k=10).collect()
    copies = [p for p in pairs if p[0] % 3 == 0 and p[1] % 3 == 0 and p[1] < 300]
    first = [3 * j for j in range(11)]
    want = {(min(a, b), max(a, b)) for a in range(0, 300, 3) for b in [x for x in first if x != a][:10]}
    assert want <= {tuple(p) for p in copies}
    same = [float(j % 7) for j in range(48)]
    profiles = [(i, same, "a", "train" if i % 2 else "test") for i in range(60)]
    assert overlap.overlapping_pairs(spark.createDataFrame(profiles, "profile_id long, kwh array<double>, source string, split string")).count() == 30 * 30
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text number {i}", "s") for i in range(90)], "doc_id long, text string, source string")
    placed = packing.pack(packing.sized_documents(docs), {"c": 32})
    assert placed.select("doc_id").distinct().count() == 90 and placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.max("t")).first()[0] <= 32
