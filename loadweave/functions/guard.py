"""Defined behaviour when an input carries columns that an operator also writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, outputs: Iterable[str]) -> DataFrame:
    """Rename input columns that clash with output names (regardless of case) to '<name>_input', numbered if that is taken too."""
    taken = {c.lower() for c in df.columns} | {o.lower() for o in outputs}
    wanted = {o.lower() for o in outputs}
    for name in df.columns:
        if name.lower() in wanted:
            fresh, i = f"{name}_input", 1
            while fresh.lower() in taken:
                i += 1
                fresh = f"{name}_input{i}"
            taken.add(fresh.lower())
            df = df.withColumnRenamed(name, fresh)
    return df
