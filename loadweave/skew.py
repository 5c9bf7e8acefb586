"""Heavy keys: found by a bounded aggregate, split by quantiles of an ordering column."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HeavyKeys:
    """Keys above a share of all rows, each with ascending cut points of the ordering column from its least to its largest value.

    At most 1/share keys can exceed the share and each has at most max_cuts + 2 bounds, so the literals in the plan are
    bounded whatever the data. Where that leaves too many rows between two cuts, each segment is divided evenly into
    `parts` more by arithmetic, without literals.
    """

    bounds: dict[str, list[int]]
    parts: int = 1

    @property
    def most_buckets(self) -> int:
        return sum(max(1, len(b) - 1) * self.parts for b in self.bounds.values())

    def bucket(self, key: Column, order: Column) -> Column:
        """Rises with the order value; 0 for ordinary keys and for null orders."""
        if not self.bounds:
            return F.lit(0).cast("long")
        table = F.create_map(*[x for k, v in sorted(self.bounds.items()) for x in (F.lit(k), F.array(*[F.lit(int(c)).cast("long") for c in v]).cast("array<bigint>"))])
        b = F.element_at(table, key)
        segment = F.greatest(F.size(F.filter(F.slice(b, 2, F.greatest(F.size(b) - 2, F.lit(0))), lambda c: c <= order)), F.lit(0))
        out = segment.cast("long")
        if self.parts > 1:
            low, high = F.get(b, segment), F.get(b, segment + 1)
            share = F.coalesce(F.try_divide(order - low, high - low), F.lit(0.0))
            out = out * self.parts + F.least(F.floor(share * self.parts), F.lit(self.parts - 1)).cast("long")
        return F.when(key.isin(list(self.bounds)), F.coalesce(out, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    def is_heavy(self, key: Column) -> Column:
        return key.isin(list(self.bounds)) if self.bounds else F.lit(False)


def heavy_keys(df: DataFrame, key: str, order: str, rows: int, share: float = 1 / 64, bucket_rows: int = 200_000, least_rows: int = 50_000, max_cuts: int = 255, counts: DataFrame | None = None, most_rows: int = 2_000_000) -> HeavyKeys:
    """Find the keys holding more than `share` of `rows` rows (and at least `least_rows`), or more than `most_rows`, and cut points for each.

    One aggregate by key with map-side combine, unless counts (key, _lw_n) are there already; only keys over the share
    reach the driver (at most 1/share, the largest).
    """
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_lw_n")) if counts is None else counts
    over = per_key.where(F.col("_lw_n") >= max(least_rows, min(share * rows, most_rows))).orderBy(F.desc("_lw_n")).limit(math.ceil(1 / share)).collect()
    if not over:
        return HeavyKeys({})
    heavy = {r[key]: r["_lw_n"] for r in over}
    largest = max(heavy.values())
    most = min(max_cuts + 1, math.ceil(largest / bucket_rows) + 1)
    grid = [i / most for i in range(1, most)] or [0.5]
    found = df.where(F.col(key).isin(list(heavy)) & F.col(order).isNotNull()).groupBy(key)
    found = found.agg(F.min(order).alias("lo"), F.percentile_approx(order, grid, 1000).alias("q"), F.max(order).alias("hi")).collect()
    bounds = {k: [] for k in heavy} | {r[key]: [r["lo"], *sorted(set(r["q"]) - {r["lo"]}), r["hi"] + 1] for r in found}
    return HeavyKeys(bounds, max(1, math.ceil(largest / most / bucket_rows)))
