"""Gaussian mixtures: full-batch EM over partitions, with NumPy kernels on Arrow batches.

The driver holds only the parameters (K means, K covariances) and adds up per-partition sufficient statistics; data
never leave the executors. Weights multiply the statistics instead of repeating rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions.randoms import normals, uniforms

EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    chol: np.ndarray  # upper factors of the precisions
    nll: float = float("inf")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, float(w), m.tolist(), c.tolist(), p.tolist()) for k, (w, m, c, p) in enumerate(zip(self.weights, self.means, self.covariances, self.chol, strict=True))]
        return spark.createDataFrame(rows, "component int, weight double, mean array<double>, cov array<array<double>>, prec_chol array<array<double>>")

    @staticmethod
    def read(table: DataFrame) -> Mixture:
        rows = table.orderBy("component").collect()  # one row per component
        return Mixture(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["cov"] for r in rows]), np.array([r["prec_chol"] for r in rows]))


def positive_definite(m: np.ndarray) -> bool:
    """Symmetric with positive eigenvalues, for one matrix or a stack."""
    m = np.asarray(m)
    return bool(np.allclose(m, np.swapaxes(m, -1, -2)) and (np.linalg.eigvalsh(m) > 0).all())


def precision_cholesky(cov: np.ndarray, reg: float = 1e-6) -> np.ndarray:
    """(L^-1)^T of each covariance; one retry with more on the diagonal, then ValueError."""
    eye = np.eye(cov.shape[-1])
    for extra in (0.0, reg):
        try:
            low = np.linalg.cholesky(cov + extra * eye)
        except np.linalg.LinAlgError:
            continue
        return np.swapaxes(np.linalg.solve(low, np.broadcast_to(eye, low.shape)), -1, -2)
    raise ValueError("a covariance is not positive definite; use more regularisation or fewer components")


def weighted_log_prob(x: np.ndarray, m: Mixture) -> np.ndarray:
    """log weight + log density, rows by components."""
    d = x.shape[1]
    out = np.empty((len(x), len(m.weights)))
    for k in range(len(m.weights)):
        z = (x - m.means[k]) @ m.chol[k]
        out[:, k] = np.log(m.weights[k]) + np.log(np.diag(m.chol[k])).sum() - 0.5 * (d * np.log(2 * np.pi) + (z * z).sum(1))
    return out


def log_sum_exp(a: np.ndarray) -> np.ndarray:
    top = a.max(1)
    return top + np.log(np.exp(a - top[:, None]).sum(1))


def e_step(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each row and log responsibilities."""
    p = weighted_log_prob(x, m)
    n = log_sum_exp(p)
    return n, p - n[:, None]


def statistics(x: np.ndarray, resp: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of r, r (x - shift) and r (x - shift)(x - shift)^T per component; the shift keeps far-off means exact."""
    k, d = resp.shape[1], x.shape[1]
    s2 = np.empty((k, d, d))
    s1 = np.empty((k, d))
    for i in range(k):
        y = x - shift[i]
        ry = resp[:, i : i + 1] * y
        s1[i], s2[i] = ry.sum(0), ry.T @ y
    return resp.sum(0), s1, s2


def m_step(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, shift: np.ndarray, reg: float) -> Mixture:
    n = n + 10 * EPS if (n == 0).any() else n + EPS
    delta = s1 / n[:, None]
    cov = s2 / n[:, None, None] - delta[:, :, None] * delta[:, None, :]
    cov = cov + reg * np.eye(s1.shape[1])
    return Mixture(n / n.sum(), shift + delta, cov, precision_cholesky(cov, reg))


def _vectors(batch: pa.RecordBatch, at: int) -> np.ndarray:
    col = batch.column(at)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _gather(df: DataFrame, vector: str, weight: str | None, make) -> list[np.ndarray]:
    """Sum per-partition statistics: one small binary row per partition, added pairwise on the executors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = make(_vectors(b, 0), b.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else [a + c for a, c in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.ravel(t) for t in total]).tolist()], pa.list_(pa.float64()))], names=["s"])

    rows = df.select(F.col(vector).cast("array<double>"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).mapInArrow(run, "s array<double>")
    parts = rows.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # as many rows as the parameters have numbers
    if not parts:
        raise ValueError("no data")
    return [np.array([r["x"] for r in parts])]


def em_round(df: DataFrame, vector: str, m: Mixture, reg: float, weight: str | None = None) -> Mixture:
    """One E and M step over all rows; nll of the result is that of the parameters it came from."""
    k, d = m.means.shape

    def make(x: np.ndarray, w: np.ndarray):
        ll, lr = e_step(x, m)
        n, s1, s2 = statistics(x, np.exp(lr) * w[:, None], m.means)
        return [n, s1, s2, np.array([(ll * w).sum(), w.sum()])]

    flat = _gather(df, vector, weight, make)[0]
    n, s1, s2, tail = np.split(flat, [k, k + k * d, k + k * d + k * d * d])
    out = m_step(n, s1.reshape(k, d), s2.reshape(k, d, d), m.means, reg)
    return Mixture(out.weights, out.means, out.covariances, out.chol, -tail[0] / tail[1])


def kmeans_labels(df: DataFrame, vector: str, k: int, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Centroids, and the rows with column label."""
    data = df.withColumn("_lw_x", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_lw_x", predictionCol="label").fit(data)
    return np.array(model.clusterCenters()), model.transform(data).drop("_lw_x")


def initial(df: DataFrame, vector: str, k: int, reg: float = 1e-6, method: str = "kmeans", weight: str | None = None, seed: int = 0) -> Mixture:
    """All parameters from hard k-means assignments; another method raises."""
    if method != "kmeans":
        raise ValueError(f"unknown initialisation {method!r}")
    centres, _ = kmeans_labels(df, vector, k, seed)
    kk, d = centres.shape

    def make(x: np.ndarray, w: np.ndarray):
        r = np.eye(kk)[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)] * w[:, None]
        return list(statistics(x, r, centres))

    n, s1, s2 = np.split(_gather(df, vector, weight, make)[0], [kk, kk + kk * d])
    return m_step(n, s1.reshape(kk, d), s2.reshape(kk, d, d), centres, reg)


def fit(df: DataFrame, vector: str, k: int, reg: float = 1e-4, tol: float = 1e-3, rounds: int = 100, weight: str | None = None, seed: int = 0) -> Mixture:
    """EM until the mean negative log-likelihood falls by no more than tol. The input is to be persisted or staged by the caller."""
    m = initial(df, vector, k, reg, weight=weight, seed=seed)
    before = float("inf")
    for _ in range(rounds):
        m = em_round(df, vector, m, reg, weight)
        if before - m.nll <= tol:
            break
        before = m.nll
    return m


def score(df: DataFrame, key: str, vector: str, m: Mixture) -> DataFrame:
    """key, log_likelihood, component (the hard assignment), responsibilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ll, lr = e_step(_vectors(b, 1), m)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ll), pa.array(lr.argmax(1).astype("int32")), pa.array(list(np.exp(lr)), pa.list_(pa.float64()))], names=[key, "log_likelihood", "component", "responsibilities"])

    return df.select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, log_likelihood double, component int, responsibilities array<double>")


def sample(spark: SparkSession, m: Mixture, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """id, component, v: n draws, each depending on its id and the seed only."""
    cum = np.cumsum(m.weights)
    low = np.linalg.cholesky(m.covariances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            comp = np.minimum(np.searchsorted(cum, uniforms(ids, 1, seed, 9)[:, 0]), len(cum) - 1).astype("int32")
            v = m.means[comp] + np.einsum("nij,nj->ni", low[comp], normals(ids, m.means.shape[1], seed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(comp), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "component", "v"])

    ids = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    return ids.mapInArrow(run, "id long, component int, v array<double>")


def component_counts(samples: DataFrame, k: int) -> DataFrame:
    """component, n for all k components, zeros included."""
    all_k = samples.sparkSession.range(k).select(F.col("id").cast("int").alias("component"))
    return all_k.join(samples.groupBy("component").agg(F.count("*").alias("n")), "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("n"))


def feature_range(df: DataFrame, features: list[str]) -> dict[str, tuple[int, int]]:
    row = df.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features]).first()
    return {f: (row[f"lo_{f}"], row[f"hi_{f}"]) for f in features}


def in_range(df: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows whose labels lie in all ranges, bounds included; a missing column or bound raises before anything runs."""
    for f, b in ranges.items():
        if f not in df.columns:
            raise KeyError(f)
        if b is None or len(b) != 2 or b[0] is None or b[1] is None:
            raise ValueError(f"no bounds for {f}")
    for f, (lo, hi) in ranges.items():
        df = df.where(F.col(f).between(lo, hi))
    return df
