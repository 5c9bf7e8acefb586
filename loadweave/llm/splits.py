"""Problem 4: splits that keep related records together.

Households that share a meter, an account or a predecessor are joined into components by hash-to-min: every node
keeps a cluster, and each round sends the cluster to its smallest member and that member to the cluster, until
nothing changes. Clusters are rows (node, member), never lists, so a component of any size is spread over tasks.
A shared attribute links each household to the smallest one that has it (a star, not all pairs). Components then go
to splits by weighted rendezvous hashing, which needs no counts and moves few components when shares change.

Defined results: ids are upper-cased and trimmed; blank ids are no households. Serials and accounts are compared by
letters and digits; a text without a digit from 1 to 9 (N/A, TBC, 0000...) is a placeholder and links nothing. A
predecessor that is no household of the register links nothing. Repeated rows change nothing; a household without
links is its own component; an empty register gives no components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.functions import readings as R
from loadweave.session import cut


def canonical_key(col: Column) -> Column:
    """Letters and digits, upper-cased; null for placeholders."""
    clean = F.upper(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))
    return F.when(clean.rlike("[1-9]"), clean)


def _household(col: Column) -> Column:
    clean = F.upper(F.trim(col))
    return F.when(clean != "", clean)


def register_links(register: DataFrame) -> DataFrame:
    """(_a, _b): links between households, linear in the rows of the register."""
    rows = register.select(
        _household(F.col("LCLid")).alias("_hh"), canonical_key(F.col("meter_serial")).alias("_meter"), canonical_key(F.col("account_ref")).alias("_account"), _household(F.col("previous_lclid")).alias("_prev")
    ).where("_hh is not null")
    keyed = rows.select("_hh", F.explode(F.array(F.struct(F.lit("m").alias("t"), F.col("_meter").alias("v")), F.struct(F.lit("a").alias("t"), F.col("_account").alias("v")))).alias("_k"))
    keyed = keyed.select("_hh", F.col("_k.t").alias("_t"), F.col("_k.v").alias("_v")).where("_v is not null").distinct()
    hub = keyed.groupBy("_t", "_v").agg(F.min("_hh").alias("_hub"))
    stars = keyed.join(hub, ["_t", "_v"]).select(F.col("_hh").alias("_a"), F.col("_hub").alias("_b"))
    known = rows.select(F.col("_hh").alias("_known")).distinct()
    moved = rows.where("_prev is not null").select(F.col("_hh").alias("_a"), F.col("_prev").alias("_b")).distinct()
    moved = moved.join(known, F.col("_b") == F.col("_known"), "left_semi")
    return stars.unionByName(moved).where("_a <> _b").distinct()


def hash_to_min(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(_node, _root): for every node of a link the smallest node it is connected with.

    Each round is checkpointed into the shared folder; the stop test moves two numbers to the driver. Rounds grow
    with the logarithm of the longest path; not settling within max_rounds raises.
    """
    c = links.select(F.explode(F.array(F.struct("_a", "_b"), F.struct(F.col("_b").alias("_a"), F.col("_a").alias("_b")), F.struct("_a", F.col("_a").alias("_b")), F.struct(F.col("_b").alias("_a"), "_b"))).alias("_e"))
    c = cut(c.select(F.col("_e._a").alias("_node"), F.col("_e._b").alias("_member")).distinct())
    print_of = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("_node", "_member").cast("decimal(38,0)"))).first())
    before = print_of(c)
    for _ in range(max_rounds):
        least = c.groupBy("_node").agg(F.min("_member").alias("_min"))
        sent = c.join(least, "_node").select(F.explode(F.array(F.struct(F.col("_min").alias("n"), F.col("_member").alias("m")), F.struct(F.col("_member").alias("n"), F.col("_min").alias("m")))).alias("_e"))
        c = cut(sent.select(F.col("_e.n").alias("_node"), F.col("_e.m").alias("_member")).distinct())
        now = print_of(c)
        if now == before:
            return c.groupBy("_node").agg(F.min("_member").alias("_root"))
        before = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def components(register: DataFrame) -> DataFrame:
    """(_node, _root) for households with a link; others are components of their own and have no row."""
    return hash_to_min(register_links(register))


def linked_households(register: DataFrame) -> DataFrame:
    """LCLid, group_lclid for every household that shares a component with another."""
    return components(register).select(F.col("_node").alias("LCLid"), F.col("_root").alias("group_lclid"))


def rendezvous(key: Column, shares: dict[str, float], seed: int = 0) -> Column:
    """Weighted rendezvous hashing: the split whose -ln(u)/share is least, u drawn by hash of key and split."""
    live = {s: w for s, w in sorted(shares.items()) if w and w > 0}
    if not live:
        raise ValueError("no split has a positive share")

    def score(split: str, share: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(split), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(float(share))).alias("s"), F.lit(split).alias("split"))

    return F.array_min(F.array(*[score(s, w) for s, w in live.items()]))["split"]


def split_shares(targets: DataFrame, most: int = 1000) -> dict[str, float]:
    """The target table as a dict; it is a configuration of at most `most` rows."""
    rows = targets.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} splits")
    return {r["split"]: r["target_share"] for r in rows if r["split"] is not None}


def split_household_days(readings: DataFrame, register: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """LCLid, date, group_lclid, split for every household-day of the readings. Rows without household or date give none."""
    days = R.with_household(readings.select("LCLid", "source_file", "date"), "_hh", R.learn_files(readings)).where("_hh is not null and date is not null").select("_hh", "date").distinct()
    groups = components(register)
    out = days.join(groups, days["_hh"] == groups["_node"], "left").withColumn("_root", F.coalesce("_root", "_hh"))
    return out.select(F.col("_hh").alias("LCLid"), "date", F.col("_root").alias("group_lclid"), rendezvous(F.col("_root"), shares, seed).alias("split"))
