"""Labelled synthetic outliers: normal or gamma rows instead of sampled profiles, drawn by hash of row and seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.functions.randoms import gammas, normals
from loadweave.operators.ordering import exact_sample

KINDS = ("gaussian", "gamma")


def noise_rows(kind: str, ids: np.ndarray, mean: float, factor: float, scale: float, width: int, seed: int) -> np.ndarray:
    """One row of noise per id, the same wherever it is drawn. gamma takes mean * factor as its shape; a shape of 0 gives zeros."""
    if kind == "gaussian":
        return mean * factor + scale * normals(ids, width, seed)
    return scale * gammas(ids, width, mean * factor, seed) if mean * factor > 0 else np.zeros((len(ids), width))


def inject_noise(df: DataFrame, key: str, vector: str, kind: str, n: int, mean: float, factor: float = 20.0, scale: float = 1.0, width: int = 48, seed: int = 0) -> DataFrame:
    """n sampled rows with the vector overwritten by noise and segment set to the kind. An unknown kind raises."""
    if kind not in KINDS:
        raise ValueError(f"unknown noise {kind!r}; one of {KINDS}")
    picked = exact_sample(df.drop("segment"), key, n, seed)
    names = picked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(names.index(key)).to_numpy(zero_copy_only=False)
            x = noise_rows(kind, ids, mean, factor, scale, width, seed)
            arrays = [pa.array(list(x), pa.list_(pa.float64())) if c == vector else b.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([kind] * b.num_rows)], names=[*names, "segment"])

    schema = ", ".join(f"`{c}` {'array<double>' if c == vector else t}" for c, t in picked.dtypes)
    return picked.mapInArrow(run, schema + ", segment string")


def create_outliers(df: DataFrame, key: str, vector: str, mean: float, n_each: int = 50, factor: float = 20.0, width: int = 48, seed: int = 0) -> DataFrame:
    """n_each Gaussian and n_each gamma outliers."""
    a = inject_noise(df, key, vector, "gaussian", n_each, mean, factor, width=width, seed=seed)
    return a.unionByName(inject_noise(df, key, vector, "gamma", n_each, mean, factor, width=width, seed=seed + 1))


def clipped(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, F.transform(vector, lambda x: F.greatest(x, F.lit(0.0))))
