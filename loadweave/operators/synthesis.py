"""Model-level operators: the training source, the latent mixture synthesiser and the attack sample builders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.functions import vectors as V
from loadweave.operators import mixture, networks, noise, ordering
from loadweave.session import stage_table


@dataclass(frozen=True)
class ProfileSource:
    """Profiles with the statistics of the training data; outliers are standardised with the same statistics."""

    profiles: DataFrame
    mean: float
    stdev: float
    features: tuple[str, ...] = ("month", "dayofweek")
    key: str = "profile_id"
    vector: str = "kwh"
    outliers: DataFrame | None = None

    def _standardised(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.vector, V.standardise(F.col(self.vector), F.lit(self.mean), F.lit(self.stdev)))

    def train(self, n: int | None = None, seed: int = 0) -> DataFrame:
        """All or exactly n rows in hash order, standardised; outliers, if given, are appended with their segment."""
        df = self.profiles if n is None else ordering.exact_sample(self.profiles, self.key, n, seed)
        return self._standardised(df if self.outliers is None else df.unionByName(self.outliers, allowMissingColumns=True))

    def outlier_rows(self) -> DataFrame:
        if self.outliers is None:
            raise ValueError("the source has no outliers")
        return self._standardised(self.outliers)

    def real_sample(self, n: int, seed: int = 0, outliers: bool = False) -> DataFrame:
        """n real rows back in units and clipped at zero, as the attacks see them; more than there are raises."""
        df = self.outlier_rows() if outliers else self._standardised(self.profiles)
        picked = ordering.first_batch(df, self.key, n, seed)
        return picked.withColumn(self.vector, V.clip_zero(V.reconstruct(F.col(self.vector), F.lit(self.mean), F.lit(self.stdev))))


@dataclass
class MixtureSynthesizer:
    """Autoencoder, mixture on its latent space with the labels, sampling within the labels' ranges, decoding."""

    config: networks.AutoencoderConfig
    components: int = 10
    epochs: int = 5
    rounds: int = 20
    reg: float = 1e-4
    seed: int = 0
    net: networks.Autoencoder | None = None
    mix: mixture.Mixture | None = None
    source: ProfileSource | None = None
    ranges: dict | None = None

    def fit(self, source: ProfileSource, net: networks.Autoencoder | None = None, private: tuple[float, float, float] | None = None) -> MixtureSynthesizer:
        """Train (or take a trained network with the same features in the same order) and fit the mixture on all rows."""
        if len(source.features) != self.config.class_dim:
            raise ValueError(f"{self.config.class_dim} features wanted, got {source.features}")
        data = source.train().where(" and ".join(f"`{f}` is not null" for f in source.features))
        data = stage_table(data.select(source.key, source.vector, *source.features), "train")
        self.source, self.net = source, net
        if net is None:
            self.net, _ = networks.train(data, source.key, source.vector, list(source.features), self.config, self.epochs, seed=self.seed, private=private)
        latent = stage_table(networks.encode(data, source.key, source.vector, list(source.features), self.net, self.seed), "latent")
        self.mix = mixture.fit(latent, "z", self.components, self.reg, rounds=self.rounds, seed=self.seed)
        self.ranges = mixture.feature_range(data, list(source.features))
        return self

    def sample(self, n: int, features: tuple[str, ...] | None = None, seed: int = 0) -> DataFrame:
        """id, kwh and the labels of the draws whose labels are in range (so at most n rows). Another feature order raises."""
        if self.mix is None or self.source is None or self.net is None:
            raise ValueError("fit first")
        names = list(self.source.features)
        if features is not None and list(features) != names:
            raise ValueError(f"features {list(features)} are not those of the fit, {names}")
        drawn = mixture.sample(self.source.profiles.sparkSession, self.mix, n, seed)
        kept = mixture.in_range(drawn.select("id", *V.parse_sample(F.col("v"), self.config.latent_dim, names)), self.ranges)
        out = networks.decode(kept, "id", "latent", names, self.net)
        kwh = V.clip_zero(V.reconstruct(F.col("v"), F.lit(self.source.mean), F.lit(self.source.stdev)))
        return out.select("id", kwh.alias("kwh"), *[F.col("f")[i].cast("int").alias(f) for i, f in enumerate(names)])


def unseen_outliers(df: DataFrame, key: str, vector: str, mean: float, n_each: int = 50, factor: float = 20.0, width: int = 48, seed: int = 101) -> DataFrame:
    """Outliers of the same kind as the injected ones, or with mean 0 of another; unlike seen ones they are not clipped."""
    return noise.create_outliers(df, key, vector, mean, n_each, factor, width, seed)


def reconstruction_set(source: ProfileSource, synthetic: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """kind, id, v: n synthetic, n real and all outlier samples in units, by which reconstruction is judged."""
    k, v = source.key, source.vector
    parts = [("synthetic_samples", ordering.exact_sample(synthetic.select(F.col("id").cast("long").alias("id"), F.col("kwh").alias("v")), "id", n, seed))]
    parts.append(("real_samples", source.real_sample(n, seed).select(F.col(k).cast("long").alias("id"), F.col(v).alias("v"))))
    if source.outliers is not None:
        parts.append(("outlier_samples", source.real_sample(source.outliers.count(), seed, outliers=True).select(F.col(k).cast("long").alias("id"), F.col(v).alias("v"))))
    out = None
    for kind, df in parts:
        one = df.select(F.lit(kind).alias("kind"), "id", "v")
        out = one if out is None else out.unionByName(one)
    return out


def attack_samples(source: ProfileSource, holdout: DataFrame, synthetic: DataFrame, n: int, n_outliers: int = 50, width: int = 48, seed: int = 0) -> dict[str, DataFrame]:
    """(id, v) frames by role: synthetic, train, holdout, seen, unseen_same, unseen_diff. Injected outliers stay out of train and holdout."""
    k, v = source.key, source.vector

    def frame(df: DataFrame) -> DataFrame:
        return df.select(F.col(k).cast("long").alias("id"), F.col(v).alias("v"))

    def clean(df: DataFrame) -> DataFrame:
        return df.where("segment is null") if "segment" in df.columns else df

    return {
        "synthetic": synthetic.select(F.col("id").cast("long").alias("id"), F.col("kwh").alias("v")),
        "train": frame(ordering.exact_sample(clean(source.profiles), k, n, seed)),
        "holdout": frame(ordering.exact_sample(clean(holdout), k, n, seed)),
        "seen": frame(source.real_sample(source.outliers.count(), seed, outliers=True)) if source.outliers is not None else frame(source.profiles.limit(0)),
        "unseen_same": frame(unseen_outliers(clean(holdout), k, v, source.mean, n_outliers, width=width, seed=seed + 101)),
        "unseen_diff": frame(unseen_outliers(clean(holdout), k, v, 0.0, n_outliers, width=width, seed=seed + 202)),
    }
