"""Problem 8: texts into containers of fixed capacity, conflict-constrained best fit.

Texts are spread by hash over groups of bounded size and packed inside each group, in decreasing size, into bins kept
by residual. Sources and duplicate clusters have bitmaps over the bins: which bins hold the source, which have no more
room for the cluster. For an item the search starts at the smallest residual that holds it and goes on to the next
larger one until the tightest compatible bin is found; the bins of a residual are masked by the bitmaps at once, so a
cluster of many copies costs no scan over its bins. There is no cap on the search: where no bin is compatible a new
one opens. Texts longer than the capacity are cut into full pieces and a rest, nothing else is cut.

Conflict: a bin takes at most `copies` items of one duplicate cluster (texts equal after case, punctuation and
whitespace are folded, and with near_copy_clusters also nearly equal ones), where `copies` is 1, or for a cluster so
large that 1 would force empty room, the least number with which the cluster fits into the bins that all tokens need
anyway. A source in `apart` never shares a bin with another source.

Defined results: null and empty texts have 0 tokens and get a place in a bin like any other. Ties in size are broken
by id. Repeated rows are placed as often as they come; rows without id are spread by their text. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.near_copies import near_copy_clusters, text_key
from loadweave.llm.overlap import canonical_source
from loadweave.llm.tokens import VOCABULARY, token_count
from loadweave.session import spread, stage_table

PLACED = "doc_id long, piece int, container string, container_id string, place int, start_token long, n_tokens long"


class Bins:
    """Open bins by residual. `heads` is a bitmap of the residuals that have bins, so a successor is one bit trick; the bins of a residual, source or cluster are bitmaps too."""

    def __init__(self, capacity: int, apart: dict[int, frozenset[int] | None], copies: dict[int, int]):
        """apart: the sources that a source may not meet, None for all others; copies: how often a cluster may be in a bin, if not once."""
        self.capacity, self.apart, self.copies = capacity, apart, copies
        self.by_room: dict[int, int] = {}
        self.heads = 0
        self.sources: dict[int, int] = {}
        self.clusters: dict[int, int] = {}
        self.count: dict[tuple[int, int], int] = {}
        self.filled: list[int] = []

    def _conflicts(self, source: int, cluster: int) -> int:
        """Bitmap of the bins that the item may not enter."""
        out = self.clusters.get(cluster, 0)
        if source in self.apart:
            met = self.apart[source]
            for s, bins in self.sources.items():
                if s != source and (met is None or s in met):
                    out |= bins
        return out

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and place of an item."""
        heads, closed = self.heads >> size << size, self._conflicts(source, cluster)
        while heads:
            low = heads & -heads
            room = low.bit_length() - 1
            fit = self.by_room[room] & ~closed
            if fit:
                first = fit & -fit
                rest = self.by_room[room] ^ first
                if rest:
                    self.by_room[room] = rest
                else:
                    del self.by_room[room]
                    self.heads ^= low
                return self._enter(first.bit_length() - 1, room - size, source, cluster)
            heads ^= low
        self.filled.append(0)
        return self._enter(len(self.filled) - 1, self.capacity - size, source, cluster)

    def _enter(self, b: int, room: int, source: int, cluster: int) -> tuple[int, int]:
        self.by_room[room] = self.by_room.get(room, 0) | 1 << b
        self.heads |= 1 << room
        self.sources[source] = self.sources.get(source, 0) | 1 << b
        most = self.copies.get(cluster, 1)
        if most > 1:
            self.count[b, cluster] = self.count.get((b, cluster), 0) + 1
        if most == 1 or self.count[b, cluster] >= most:
            self.clusters[cluster] = self.clusters.get(cluster, 0) | 1 << b
        self.filled[b] += 1
        return b, self.filled[b] - 1


def conflicts(apart: Iterable[str], numbers: dict[str, int]) -> dict[int, frozenset[int] | None]:
    """A source in apart meets no other; the others may not meet those in apart."""
    alone = {numbers[s] for s in apart if s in numbers}
    return {} if not alone else {n: None if n in alone else frozenset(alone) for n in numbers.values()}


def sized_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, _source, _tokens, _cluster of every document, written once to the shared folder (texts are read once)."""
    source = F.coalesce(canonical_source(F.col("source")), F.lit(""))
    out = spread(documents.select("doc_id", "source", "text")).select("doc_id", source.alias("_source"), token_count(F.col("text"), path).alias("_tokens"), text_key(F.col("text")).alias("_cluster"))
    return stage_table(out, "sizes")


def cluster_near_copies(sized: DataFrame, documents: DataFrame) -> DataFrame:
    """sized with the clusters of texts that are nearly equal joined into one."""
    near = near_copy_clusters(documents)
    return sized.join(near, sized["_cluster"] == near["_t"], "left").select("doc_id", "_source", "_tokens", F.coalesce("_root", "_cluster").alias("_cluster"))


def pack(sized: DataFrame, containers: dict[str, int], group_rows: int = 20_000, apart: Iterable[str] = ()) -> DataFrame:
    """doc_id, piece, container, container_id, place, start_token, n_tokens for every document and container class."""
    for name, capacity in containers.items():
        if capacity is None or capacity < 1:
            raise ValueError(f"container {name!r} has no capacity")
    n = sized.count()
    groups = max(1, math.ceil(n / group_rows))
    apart = sorted(apart)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        name, group = key[0].as_py(), key[1].as_py()
        capacity = containers[name]
        ids, sources, sizes = t.column("doc_id").to_pylist(), t.column("_source").to_pylist(), t.column("_tokens").to_pylist()
        number: dict[int, int] = {}
        clusters = [number.setdefault(c, len(number)) for c in t.column("_cluster").to_pylist()]
        items = []
        for i, s in enumerate(sizes):
            full, rest = divmod(s, capacity) if s > capacity else (0, s)
            items += [(capacity, i, p) for p in range(full)]
            if rest or not full:
                items.append((rest, i, full))
        need = max(1, math.ceil(sum(sizes) / capacity))
        count: dict[int, int] = {}
        for _, i, _ in items:
            count[clusters[i]] = count.get(clusters[i], 0) + 1
        source_number: dict[str, int] = {}
        own = [source_number.setdefault(s, len(source_number)) for s in sources]
        bins = Bins(capacity, conflicts(apart, source_number), {c: math.ceil(m / need) for c, m in count.items() if m > need})
        items.sort(key=lambda x: (-x[0], ids[x[1]] or 0, x[2]))
        out = []
        for size, i, piece in items:
            b, place = bins.put(size, own[i], clusters[i])
            out.append((ids[i], piece, name, f"{name}-{group}-{b}", place, piece * capacity, size))
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "container", "container_id", "place", "start_token", "n_tokens"])

    classes = F.explode(F.array(*[F.lit(c) for c in containers]))
    keyed = sized.withColumn("_container", classes).withColumn("_group", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("_cluster", "_tokens")).otherwise(F.xxhash64("doc_id", F.lit(11))), F.lit(groups)))
    return keyed.groupBy("_container", "_group").applyInArrow(run, PLACED)


def container_report(placed: DataFrame, containers: dict[str, int]) -> DataFrame:
    """Per class: containers, texts, pieces, tokens and the share of room that is filled."""
    used = placed.groupBy("container").agg(F.countDistinct("container_id").alias("n_containers"), F.countDistinct("doc_id").alias("n_texts"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    room = F.create_map(*[x for k, v in containers.items() for x in (F.lit(k), F.lit(float(v)))])
    return used.withColumn("fill", F.try_divide("n_tokens", F.col("n_containers") * F.element_at(room, F.col("container"))))
