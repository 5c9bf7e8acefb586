"""Problem 9: mix sources to target weights by weighted fair queueing.

Documents of a source are shuffled by hash; a document's virtual finish time is the tokens of its source up to and
with it, divided by the source's weight; repeats go on where the pass before ended. Everything that finishes by the
budget is drawn, in order of finish time. The running sums are hierarchical: tokens per source and hash bucket are
summed with map-side combine and prefix-summed over the buckets in two levels, then within a bucket, so no task holds a
whole source.

Weights of sources without documents are shared out among the others. The default budget is the largest with which
every source keeps its share within its allowed repeats.

Defined results: sources are compared regardless of case, blanks and '-'/'_'; documents of sources without target,
or with a share or repeats of 0, are not drawn; documents without tokens are drawn with the next one. An empty table draws nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadweave.llm.overlap import canonical_source


def mix_plan(targets: DataFrame, most: int = 10_000) -> dict[str, tuple[float, int]]:
    """source -> (share, repeats): a configuration of at most `most` rows."""
    rows = targets.select(canonical_source(F.col("source")).alias("s"), "target_share", "max_repeats").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return {r["s"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows if r["s"]}


def draw_mix(sized: DataFrame, plan: dict[str, tuple[float, int]], budget: int | None = None, seed: int = 0, bucket_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, source, repeat (from 1), n_tokens, virtual_finish of every drawn document, in order of virtual_finish."""
    spark = sized.sparkSession
    live = {s: p for s, p in plan.items() if p[0] > 0 and p[1] > 0}
    docs = sized.select("doc_id", "_source", F.col("_tokens").alias("n_tokens")).where(F.col("_source").isin(list(live)) if live else F.lit(False))
    # at most one row per configured source
    supply = {r["_source"]: r["t"] for r in docs.groupBy("_source").agg(F.sum("n_tokens").alias("t")).collect() if r["t"]}
    schema = "doc_id long, source string, repeat int, n_tokens long, virtual_finish double"
    if not supply:
        return spark.createDataFrame([], schema)
    total = sum(live[s][0] for s in supply)
    weight = {s: live[s][0] / total for s in supply}
    reach = min(supply[s] * live[s][1] / weight[s] for s in supply)
    limit = float(reach if budget is None else budget)

    rows = [(s, weight[s], live[s][1], supply[s], max(1, math.ceil(supply[s] / bucket_tokens))) for s in sorted(supply)]
    side = max(1, math.isqrt(max(r[4] for r in rows)))
    config = F.broadcast(spark.createDataFrame(rows, "_source string, _w double, _r int, _t long, _nb int"))  # as many rows as sources
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    docs = docs.join(config, "_source").withColumn("_h", h).withColumn("_bucket", F.floor(F.col("_h") / F.lit(2.0**63) * F.col("_nb")).cast("int"))
    sums = docs.groupBy("_source", "_bucket").agg(F.sum("n_tokens").alias("_s"))
    # buckets grow with the tokens, so they are summed up in two levels: about their root in each window
    sums = sums.withColumn("_top", F.floor(F.col("_bucket") / side).cast("int"))
    tops = sums.groupBy("_source", "_top").agg(F.sum("_s").alias("_t"))
    tops = tops.withColumn("_first", F.sum("_t").over(Window.partitionBy("_source").orderBy("_top")) - F.col("_t")).drop("_t")
    inner = F.sum("_s").over(Window.partitionBy("_source", "_top").orderBy("_bucket"))
    before = sums.withColumn("_inner", inner - F.col("_s")).join(tops, ["_source", "_top"]).select("_source", "_bucket", (F.col("_first") + F.col("_inner")).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("_in", F.sum("n_tokens").over(inside)).join(before, ["_source", "_bucket"])
    first = F.col("_before") + F.col("_in")
    # passes that can finish in time: first + p * total <= limit * weight
    passes = F.least(F.col("_r"), F.floor((F.lit(limit) * F.col("_w") * (1 + 1e-12) - first) / F.col("_t")).cast("int") + 1)
    drawn = docs.withColumn("_p", F.explode(F.when(passes >= 1, F.sequence(F.lit(1), passes)).otherwise(F.array().cast("array<int>"))))
    finish = (first + (F.col("_p") - 1) * F.col("_t")) / F.col("_w")
    return drawn.select("doc_id", F.col("_source").alias("source"), F.col("_p").alias("repeat"), "n_tokens", finish.alias("virtual_finish")).orderBy("virtual_finish", "source", "doc_id")


def mix_report(drawn: DataFrame, plan: dict[str, tuple[float, int]]) -> DataFrame:
    """source, target_share, n_drawn, n_texts, most_repeats, n_tokens, actual_share for every configured source."""
    spark = drawn.sparkSession
    per = drawn.groupBy("source").agg(F.count("*").alias("n_drawn"), F.countDistinct("doc_id").alias("n_texts"), F.max("repeat").alias("most_repeats"), F.sum("n_tokens").alias("n_tokens"))
    wanted = spark.createDataFrame([(s, p[0]) for s, p in sorted(plan.items())] or [], "source string, target_share double")
    out = wanted.join(per, "source", "left").na.fill(0, ["n_drawn", "n_texts", "most_repeats", "n_tokens"])
    # one row per configured source
    return out.withColumn("actual_share", F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(Window.partitionBy())), F.lit(0.0)))
