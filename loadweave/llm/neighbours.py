"""Problem 2: the most similar vectors for every vector, by an adaptive dimension scan inside probed lists.

Vectors are turned by a random rotation (distances stay, energy spreads evenly over the columns) and assigned to the
nearest of a set of centroids: one flat set, or for many lists a tree of two levels. Every vector is stored in its own
list and asked in the lists it probes. Within a list distances grow by column blocks; after a block a candidate is
abandoned when a hypothesis test rejects, from its partial distance, that it can be under the bound, and survivors get
their whole distance.

With `max_ratio` the bound is that share of the query's norm and the probed lists are exactly those whose cell can
hold a vector within it (on each level the distance to the bisecting plane of two cells is at most the bound), so the
lists lose nothing. Without it the `nprobe` nearest lists are probed, at least `probe_share` of all; recall is then
measured (README).

Only the centroids are fitted on a sample, chosen by hash: a 64th of the vectors, at least 10,000 and about
`sample_rows` (default 200,000) at most. All vectors are indexed. There are as many lists as give each `list_rows` vectors,
and at most one for eight sampled vectors. Lists and askers are cut into blocks of bounded size from sample counts, so
no group grows with the data. Between tasks vectors travel unrotated and packed without loss (decimals as 16-bit
numbers where that is exact), and copies of one vector travel once: only the few ids beyond a class's first are
left out, by an anti-join that is broadcast up to a counted size.

Defined results: vectors that are null, of another length, or hold null, NaN or infinite values take no part. Ties in
the squared distance rounded to 6 decimals go to the smaller id. A collection of one vector, or none, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.session import stage_table

ROUND = 6


def finite_vector(v: Column, width: int) -> Column:
    return F.coalesce(F.size(v) == width, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rotation(width: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Plain Lloyd iterations on the bounded sample; empty centres keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * (x @ c.T), 0.0)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 1024) -> np.ndarray:
    return np.concatenate([squared(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


class Lists:
    """Centroids in one or two levels. A vector belongs to the nearest cell of the first and there of the second level."""

    def __init__(self, z: np.ndarray, lists: int, flat: int = 256, seed: int = 7):
        top = 1 if lists <= flat else int(np.ceil(np.sqrt(lists)))
        self.tops = kmeans(z, top, seed=seed) if top > 1 else z.mean(0, keepdims=True)
        at = nearest(z, self.tops)
        self.leaves = []
        for i in range(top):
            own = z[at == i]
            k = max(1, min(len(own) // 2, round(lists * len(own) / len(z)))) if top > 1 else lists
            self.leaves.append(kmeans(own, k, seed=seed) if k > 1 else (own.mean(0, keepdims=True) if len(own) else self.tops[i : i + 1]))
        self.first = np.cumsum([0, *map(len, self.leaves)])
        self.gaps = [np.sqrt(squared(c, c)) for c in (self.tops, *self.leaves)]

    def __len__(self) -> int:
        return int(self.first[-1])

    def own(self, x: np.ndarray) -> np.ndarray:
        top = nearest(x, self.tops)
        out = np.zeros(len(x), int)
        for i in np.unique(top):
            rows = np.flatnonzero(top == i)
            out[rows] = self.first[i] + nearest(x[rows], self.leaves[i])
        return out

    @staticmethod
    def _cells(x: np.ndarray, c: np.ndarray, gaps: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) where a ball around the row can reach into the cell."""
        d = squared(x, c)
        near = d.argmin(1)
        plane = (d - d[np.arange(len(x)), near][:, None]) / np.maximum(2.0 * gaps[near], 1e-300)
        ask = plane <= (bound * (1 + 1e-9) + 1e-12)[:, None]
        ask[np.arange(len(x)), near] = True
        return np.nonzero(ask)

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every list that can hold a vector within the bound of the row."""
        row, top = self._cells(x, self.tops, self.gaps[0], bound)
        rows, lists = [], []
        for i in np.unique(top):
            own = row[top == i]
            r, leaf = self._cells(x[own], self.leaves[i], self.gaps[1 + i], bound[own])
            rows.append(own[r])
            lists.append(self.first[i] + leaf)
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, int), np.zeros(0, int))

    def closest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the n nearest lists, looked for in the nearest cells of the first level that hold about 4 n lists."""
        n = min(n, len(self))
        few = len(self.tops) if len(self) <= 4 * n else min(len(self.tops), int(np.ceil(4 * n * len(self.tops) / len(self))) + 1)
        d = squared(x, self.tops)
        top = np.argpartition(d, few - 1, axis=1)[:, :few]
        far = np.full((len(x), len(self)), np.inf)
        for i in np.unique(top):
            rows = np.flatnonzero((top == i).any(1))
            far[np.ix_(rows, np.arange(self.first[i], self.first[i + 1]))] = squared(x[rows], self.leaves[i])
        lists = np.argpartition(far, n - 1, axis=1)[:, :n]
        known = np.isfinite(np.take_along_axis(far, lists, 1))
        return np.nonzero(known)[0], lists[known]


# ---------------------------------------------------------------- vectors on their way
def packed(x: np.ndarray) -> list[bytes]:
    """One byte for the kind and the values: thousandths as 16 bits where every value is exactly that, else 64-bit numbers."""
    with np.errstate(invalid="ignore", over="ignore"):
        t = np.rint(x * 1000)
        short = ((np.abs(t) < 32768) & (t / 1000 == x)).all(1)
    small = np.where(short[:, None], t, 0).astype("<i2")
    return [b"s" + a.tobytes() if ok else b"d" + b.tobytes() for ok, a, b in zip(short.tolist(), small, x, strict=True)]


def unpacked(values: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(values), width))
    short = [i for i, v in enumerate(values) if v[:1] == b"s"]
    if short:
        out[short] = np.frombuffer(b"".join(values[i][1:] for i in short), "<i2").reshape(-1, width) / 1000
    if len(short) < len(values):
        long = [i for i, v in enumerate(values) if v[:1] == b"d"]
        out[long] = np.frombuffer(b"".join(values[i][1:] for i in long)).reshape(-1, width)
    return out


def _lifted(v: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Two more columns, so that the product of a lifted query and a lifted vector is at least 0 where their squared distance is within the limit."""
    n = (v * v).sum(1)
    more = (np.ones(len(v)), -n / 2) if limit is None else ((limit * 1.001 + 1e-4 * n - n) / 2, np.ones(len(v)))
    with np.errstate(over="ignore"):
        return np.column_stack([v, *more]).astype(np.float32)


def scan_list(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, bound: np.ndarray | None, block: int = 16, eps: float = 2.1, step: int = 512):
    """The k nearest of x for each q: (row of q, row of x, squared distance); rows with equal id are passed over.

    bound: squared bound per query, or None to take it from the k candidates of least first-block distance.
    """
    dims = q.shape[1]
    lead_share = min(1.0, block / dims * (1 + eps / np.sqrt(block)) ** 2)
    lead_x = None if bound is None else _lifted(x[:, :block])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), step):
        qs, ids = q[s : s + step], qid[s : s + step]
        if bound is None:
            part = squared(qs[:, :block], x[:, :block])
            part[ids[:, None] == xid[None]] = np.inf
            if len(x) > k:
                lead = np.argpartition(part, k, axis=1)[:, : k + 1]
                full = ((qs[:, None] - x[lead]) ** 2).sum(2)
                full[np.isinf(np.take_along_axis(part, lead, 1))] = np.inf
                lim = np.partition(full, k - 1, axis=1)[:, k - 1] + 10.0**-ROUND
            else:
                lim = np.full(len(qs), np.inf)
        else:
            lim = bound[s : s + step]
        lim = lim * (1 + 1e-9) + 1e-12
        if bound is None:
            i, j = np.nonzero((part <= lim[:, None] * lead_share) & np.isfinite(part))
            d = part[i, j]
        else:
            # one product in single precision with a slack for what it rounds; survivors are tested again exactly
            i, j = np.nonzero(~(_lifted(qs[:, :block], lim * lead_share) @ lead_x.T < 0))
            d = ((qs[i, :block] - x[j, :block]) ** 2).sum(1)
            live = (d <= lim[i] * lead_share) & (ids[i] != xid[j])
            i, j, d = i[live], j[live], d[live]
        for b in range(block, dims, block):
            e = min(b + block, dims)
            d = d + ((qs[i, b:e] - x[j, b:e]) ** 2).sum(1)
            share = min(1.0, e / dims * (1 + eps / np.sqrt(e)) ** 2) if e < dims else 1.0
            live = d <= lim[i] * share
            i, j, d = i[live], j[live], d[live]
        if not len(i):
            continue
        d = ((qs[i] - x[j]) ** 2).sum(1)
        order = np.lexsort((xid[j], np.round(d, ROUND), i))
        i, j, d = i[order], j[order], d[order]
        first = np.r_[True, i[1:] != i[:-1]]
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
        top = rank < k
        out.append((i[top] + s, j[top], d[top]))
    if not out:
        e = np.zeros(0, int)
        return e, e, np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def knn(base: DataFrame, queries: DataFrame, width: int, k: int = 10, max_ratio: float | None = None, nprobe: int = 32, probe_share: float = 0.0, list_rows: int = 512, sample_rows: int = 200_000, block_rows: int = 4096, eps: float = 2.1, seed: int = 7, flat: int = 256) -> DataFrame:
    """(_q, _x, _d2, _nq, _nx): for each query up to k nearest base vectors of another id, and both norms. Both inputs are (_id, _v), finite.

    The driver gets the sample (bounded) and one count; everything else stays distributed.
    """
    spark = base.sparkSession
    out_schema = "_q long, _x long, _d2 double, _nq double, _nx double"
    n = base.count()
    if n < 2:
        return spark.createDataFrame([], out_schema)
    rot = rotation(width, seed)
    some = max(1, min(sample_rows, max(10_000, n // 64)))
    # by a threshold of the hash, so nothing is sorted; about `some` rows, never many more
    picked = base if n <= some else base.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * some / n))
    sample = picked.select("_v").toArrow().column("_v").combine_chunks()
    z = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) @ rot
    z = z[np.lexsort(z.T)]  # the same lists in whatever order the rows come
    index = Lists(z, max(1, min(n // list_rows, len(z) // 8)), flat, seed)

    nprobe = max(nprobe, int(np.ceil(probe_share * len(index))))

    def asks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return index.closest(x, nprobe) if max_ratio is None else index.within(x, max_ratio * np.sqrt((x * x).sum(1)))

    stored, asked = np.zeros(len(index), int), np.zeros(len(index), int)
    for s in range(0, len(z), 1024):
        stored += np.bincount(index.own(z[s : s + 1024]), minlength=len(index))
        asked += np.bincount(asks(z[s : s + 1024])[1], minlength=len(index))
    grow = n / len(z)
    data_blocks = np.maximum(1, np.ceil(stored * grow / block_rows)).astype(int)
    ask_blocks = np.maximum(1, np.ceil(asked * grow / (4 * block_rows))).astype(int)

    def place(kind: int):
        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                col = batch.column(1)
                x = col.values.to_numpy(zero_copy_only=False)[col.offsets[0].as_py() : col.offsets[-1].as_py()].reshape(-1, width)
                for s in range(0, len(ids), 1024):
                    xi, ii = x[s : s + 1024], ids[s : s + 1024]
                    if kind == 0:
                        at, r = index.own(xi @ rot), np.arange(len(ii))
                        mine, copies = data_blocks[at], ask_blocks[at]
                    else:
                        r, at = asks(xi @ rot)
                        mine, copies = ask_blocks[at], data_blocks[at]
                    # a row goes to one block of its own kind and to every block of the other kind
                    r, at, m = np.repeat(r, copies), np.repeat(at, copies), np.repeat(mine, copies)
                    o = np.arange(len(r)) - np.repeat(np.cumsum(copies) - copies, copies)
                    salt = (ii[r] * 2654435761 % 2**31) % m
                    a, b = (salt, o) if kind == 0 else (o, salt)
                    if len(r):
                        vec = packed(xi)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(at, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.full(len(r), kind), pa.int8()), pa.array(ii[r], pa.int64()), pa.array([vec[i] for i in r.tolist()], pa.binary())],
                            names=["_l", "_a", "_b", "_kind", "_id", "_z"],
                        )

        return run

    placed_schema = "_l int, _a int, _b int, _kind byte, _id long, _z binary"
    placed = base.select("_id", "_v").mapInArrow(place(0), placed_schema).unionByName(queries.select("_id", "_v").mapInArrow(place(1), placed_schema))

    def scan(t: pa.Table) -> pa.Table:
        kind = t.column("_kind").to_numpy()
        ids = t.column("_id").to_numpy()
        vec = unpacked(t.column("_z").to_pylist(), width) @ rot
        x, q = vec[kind == 0], vec[kind == 1]
        xi, qi = ids[kind == 0], ids[kind == 1]
        if not len(x) or not len(q):
            i = j = np.zeros(0, int)
            d = np.zeros(0)
        else:
            lim = None if max_ratio is None else max_ratio**2 * (q * q).sum(1)
            i, j, d = scan_list(q, qi, x, xi, k, lim, eps=eps)
        norm = lambda v: pa.array(np.sqrt((v * v).sum(1)), pa.float64())
        return pa.table({"_q": pa.array(qi[i], pa.int64()), "_x": pa.array(xi[j], pa.int64()), "_d2": pa.array(d, pa.float64()), "_nq": norm(q[i]), "_nx": norm(x[j])})

    found = placed.groupBy("_l", "_a", "_b").applyInArrow(scan, out_schema)
    w = Window.partitionBy("_q").orderBy(F.round("_d2", ROUND), "_x")
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def _small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A staged table of ids, broadcast up to a counted size."""
    return F.broadcast(df) if df.count() <= rows else df


def split_copies(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each class of equal vectors by its smallest id: (_id, _v) of the classes; of classes of several (_class, _ids: the k + 1 smallest ids) and (_id, _class), both staged.

    Only hashes and ids are grouped; the vectors themselves stay where they are.
    """
    hashed = vectors.select("_id", F.xxhash64(F.lit(1), "_v").alias("_k1"), F.xxhash64("_v", F.lit(2)).alias("_k2"))
    several = hashed.groupBy("_k1", "_k2").agg(F.min("_id").alias("_class"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies = stage_table(hashed.join(several, ["_k1", "_k2"]).select("_id", "_class"), "copies")
    # the group limit is pushed below the shuffle: a class of any size sends at most k + 1 ids a task
    few = copies.withColumn("_r", F.row_number().over(Window.partitionBy("_class").orderBy("_id"))).where(F.col("_r") <= k + 1)
    ids = stage_table(few.groupBy("_class").agg(F.sort_array(F.collect_list("_id")).alias("_ids")), "classes")
    extra = copies.where("_id <> _class").select("_id")
    return vectors.join(_small(extra), "_id", "left_anti"), ids, copies


def nearest_by_member(found: DataFrame, ids: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """(_a, _b, _d2, _na, _nb, _rank): the k nearest of each member, from the nearest classes of its class and their ids."""
    near = found.join(_small(ids), F.col("_x") == F.col("_class"), "left").select("_q", F.explode(F.coalesce("_ids", F.array("_x"))).alias("_b"), "_d2", "_nq", "_nx")
    # within a class the distance is 0 and both norms are equal; 1 stands for them
    own = ids.select(F.col("_class").alias("_q"), F.explode("_ids").alias("_b"), F.lit(0.0).alias("_d2"), F.lit(1.0).alias("_nq"), F.lit(1.0).alias("_nx"))
    w = Window.partitionBy("_q").orderBy(F.round("_d2", ROUND), "_b")
    pool = near.unionByName(own).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    lists = pool.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_r", "_b", "_d2", "_nq", "_nx"))).alias("_l"))
    each = lists.join(_small(copies), F.col("_q") == F.col("_class"), "left").select(F.coalesce("_id", "_q").alias("_a"), "_l")
    each = each.select("_a", F.posexplode(F.slice(F.filter("_l", lambda s: s["_b"] != F.col("_a")), 1, k)).alias("_p", "_s"))
    return each.select("_a", F.col("_s._b").alias("_b"), F.col("_s._d2").alias("_d2"), F.col("_s._nq").alias("_na"), F.col("_s._nx").alias("_nb"), (F.col("_p") + 1).alias("_rank"))


def close_pairs(samples: DataFrame, id_col: str = "sample_id", vector_col: str = "kwh", width: int = 48, k: int = 10, max_ratio: float = 0.1, list_rows: int = 2048) -> DataFrame:
    """sample_id_a < sample_id_b where one is among the other's k nearest and their distance is at most max_ratio times the smaller norm."""
    v = samples.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where(finite_vector(F.col("_v"), width))
    only, ids, copies = split_copies(v, k)
    found = knn(only, only, width, k + 1, max_ratio=max_ratio, list_rows=list_rows)
    best = nearest_by_member(found, ids, copies, k).where(F.sqrt("_d2") <= max_ratio * F.least("_na", "_nb") * (1 + 1e-12))
    return best.select(F.least("_a", "_b").alias(f"{id_col}_a"), F.greatest("_a", "_b").alias(f"{id_col}_b")).distinct()


def nearest_samples(samples: DataFrame, id_col: str = "sample_id", vector_col: str = "kwh", width: int = 48, k: int = 10, nprobe: int = 48, probe_share: float = 0.02, every: int = 100, list_rows: int = 512) -> DataFrame:
    """sample_id, neighbour_id, rank, distance: the k nearest of every query (ids divisible by `every`; 1 asks all) against all rows."""
    v = samples.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where(finite_vector(F.col("_v"), width))
    only, ids, copies = split_copies(v, k)
    # classes that are asked through another member only
    others = copies.where((F.col("_id") % every == 0) & (F.col("_class") % every != 0)).select(F.col("_class").alias("_id")).distinct()
    q = only.where(F.col("_id") % every == 0).unionByName(only.join(_small(others), "_id", "left_semi").select("_id", "_v"))
    found = knn(only, q, width, k + 1, nprobe=nprobe, probe_share=probe_share, list_rows=list_rows)
    best = nearest_by_member(found, ids, copies, k).where(F.col("_a") % every == 0)
    return best.select(F.col("_a").alias(id_col), F.col("_b").alias("neighbour_id"), F.col("_rank").alias("rank"), F.sqrt("_d2").alias("distance"))
