"""The contract: every query has a unique name, oracle keys are queries, and the flagship query runs."""

import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p1_found", "p3_found", "p6_found"} <= set(q)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["household", "slot_date", "settlement_period", "kwh", "is_hole", "fill"] and df.limit(5).count() == 5
