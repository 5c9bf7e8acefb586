"""Column functions on fixed-length numeric arrays. Null arrays and null elements stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def standardise(v: Column, mean: Column, stdev: Column) -> Column:
    """z = (x - mean) / stdev; null where stdev is 0."""
    return F.transform(as_double(v), lambda x: F.try_divide(x - mean, stdev))


def reconstruct(z: Column, mean: Column, stdev: Column) -> Column:
    return F.transform(as_double(z), lambda x: x * stdev + mean)


def clip_zero(v: Column) -> Column:
    return F.transform(as_double(v), lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def parse_array(text: Column) -> Column:
    """'[0.1, 0.2]' as array<double>; null where the text is no array."""
    return F.from_json(text, "array<double>")


def concat_features(v: Column, *features: Column) -> Column:
    """Profile followed by its features, in the given order."""
    return F.concat(as_double(v), F.array(*[f.cast("double") for f in features]))


def parse_sample(v: Column, latent: int, features: list[str]) -> list[Column]:
    """Split a vector into its latent part and integer labels, rounded half to even, read from the tail by position."""
    n = len(features)
    labels = [F.element_at(v, -(n - i)) for i in range(n)]
    return [F.slice(v, 1, latent).alias("latent"), *[F.rint(x).cast("int").alias(name) for x, name in zip(labels, features, strict=True)]]


def squared_norm(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def as_column_vector(col: Column, kind: str) -> Column:
    """Scalars become arrays of one; arrays stay; other types raise."""
    if kind.startswith("array<"):
        return as_double(col)
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        return F.array(col.cast("double"))
    raise TypeError(f"no vector: {kind}")


def flatten_channels(v: Column) -> Column:
    """(channel, length) as one row of channel * length values."""
    return F.flatten(v)


def split_channels(v: Column, channels: int) -> Column:
    """A row of channel * length values as (channel, length)."""
    step = F.size(v) / channels
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.slice(v, (i * step + 1).cast("int"), step.cast("int")))


def sinusoidal_embedding(pos: Column, dim: int) -> Column:
    """[sin(p w_i), cos(p w_i)], w_i = exp(-i ln 10000 / (d/2 - 1)); the dimension must be even and at least 4."""
    if dim % 2 or dim < 4:
        raise ValueError("the dimension must be even and at least 4")
    half = dim // 2
    arg = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: pos * F.exp(-i * F.lit(9.210340371976184) / F.lit(float(half - 1))))
    return F.concat(F.transform(arg, F.sin), F.transform(arg, F.cos))
