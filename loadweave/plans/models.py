"""Queries of random or iterative operators: their rows depend on seeds, so they have no SQL twin."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions import schedule as S
from loadweave.functions import vectors as V
from loadweave.operators import attacks, diffusion, mixture, networks, noise
from loadweave.plans.profiles import PR, profiles, vectors
from loadweave.session import shared_dir, stage_table
from loadweave.sources import profiles as P
from loadweave.sources.tables import table
from loadweave.streaming import shards

#: shards of the whole profiles in hash order, the first n mod 4 with one more
ORACLE = {
    "stream_profiles": f"""WITH {PR}, p AS (SELECT profile_id, row_number() OVER (ORDER BY md5(CAST(profile_id AS VARCHAR) || '|0'), profile_id) AS pos, count(*) OVER () AS n FROM pr)
SELECT profile_id, CAST(CASE WHEN pos - 1 < (n % 4) * (n // 4 + 1) THEN (pos - 1) // (n // 4 + 1) ELSE n % 4 + (pos - 1 - (n % 4) * (n // 4 + 1)) // (n // 4) END AS INTEGER) AS shard FROM p"""
}


def inject_noise(spark: SparkSession, d: str) -> DataFrame:
    mean = table(spark, d, "mean_std").first()["mean"]
    return noise.create_outliers(profiles(spark, d), "profile_id", "kwh", mean).select("profile_id", "segment", V.rounded(F.col("kwh")).alias("kwh"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Six four-hour means of each whole profile, staged once because training reads them every round."""
    six = F.array(*[_part_mean(i) for i in range(6)])
    return stage_table(profiles(spark, d).select("profile_id", six.alias("v")), "points")


def _part_mean(i: int):
    part = F.slice("kwh", 8 * i + 1, 8)
    return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / 8


def gmm_fit(spark: SparkSession, d: str) -> DataFrame:
    m = mixture.fit(_points(spark, d), "v", 5, rounds=15)
    return m.table(spark).select("component", F.round("weight", 6).alias("weight"), V.rounded(F.col("mean")).alias("mean"))


def gmm_sample(spark: SparkSession, d: str) -> DataFrame:
    m = mixture.fit(_points(spark, d), "v", 5, rounds=5)
    return mixture.component_counts(mixture.sample(spark, m, 10_000), 5)


def _small() -> networks.AutoencoderConfig:
    return networks.AutoencoderConfig(latent_dim=8, hidden=(64, 32))


def _training_data(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "mean_std").first()
    p = profiles(spark, d).where("month is not null and dayofweek is not null")
    return stage_table(p.select("profile_id", V.standardise(F.col("kwh"), F.lit(s["mean"]), F.lit(s["stdev"])).alias("z"), "month", "dayofweek"), "train")


def vae_generate(spark: SparkSession, d: str) -> DataFrame:
    """Train the autoencoder, fit the mixture on its latent space, sample, keep labels in range, decode, bring to kWh."""
    features = ["month", "dayofweek"]
    data = _training_data(spark, d)
    net, _ = networks.train(data, "profile_id", "z", features, _small(), epochs=5)
    latent = stage_table(networks.encode(data, "profile_id", "z", features, net), "latent")
    m = mixture.fit(latent, "z", 4, rounds=5)
    drawn = mixture.sample(spark, m, 1000).select("id", *V.parse_sample(F.col("v"), 8, features))
    kept = mixture.in_range(drawn, mixture.feature_range(data, features))
    s = table(spark, d, "mean_std").first()
    out = networks.decode(kept, "id", "latent", features, net)
    return out.select("id", V.rounded(V.clip_zero(V.reconstruct(F.col("v"), F.lit(s["mean"]), F.lit(s["stdev"])))).alias("kwh"), F.col("f").alias("features"))


def vae_private_losses(spark: SparkSession, d: str) -> DataFrame:
    data = _training_data(spark, d)
    n = max(2, data.count())
    _, losses = networks.train(data, "profile_id", "z", ["month", "dayofweek"], networks.AutoencoderConfig(latent_dim=4, hidden=(16,)), epochs=2, private=(8.0, 1 / n, 1.0))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


def _denoiser() -> diffusion.Diffusion:
    net = networks.Denoiser.fresh(seed=3, width=16, heads=4, layers=1, feed=32)
    return diffusion.Diffusion(net, steps=200)


def dpm_sample(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.generate(spark, _denoiser(), 500, steps=15).select("id", V.rounded(F.col("v")).alias("v"))


def ancestral_sample(spark: SparkSession, d: str) -> DataFrame:
    slow = diffusion.Diffusion(networks.Denoiser.fresh(seed=3, width=16, heads=4, layers=1, feed=32), steps=50)
    return diffusion.generate(spark, slow, 100, fast=False).select("id", V.rounded(F.col("v")).alias("v"))


def mia_discriminator(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    train = attacks.attack_train_set(v.where("kind = 'real_samples'"), v.where("kind = 'synthetic_samples'"))
    attack = attacks.attack_set(v.where("segment = 'gaussian'"), v.where("segment = 'gamma'"), v.where("kind = 'outlier_samples' and segment is null"))
    return attacks.discriminator(train, attack, rounds=20).select("id", "target", "type", F.round("pred_proba", 6).alias("pred_proba"), "pred_label")


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return attacks.pca_2d(v.where("kind = 'real_samples'"), v.where("kind <> 'outlier_samples'")).select("id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def schedule_logsnr_steps(spark: SparkSession, d: str) -> DataFrame:
    ns = S.NoiseSchedule(S.Schedule.DISCRETE, _denoiser().bar)
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(S.time_steps(ns, "logSNR", 1.0, 1 / 200, 20))], "i int, t double")


def stream_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Shards written once, read back as a stream in micro-batches until they are drained."""
    base = os.path.join(shared_dir(spark), f"loadweave-stream-{uuid.uuid4().hex}")
    P.write_shards(profiles(spark, d), f"{base}/in", "profile_id", 4)
    schema = spark.read.parquet(f"{base}/in").schema
    rows = shards.stream_profiles(spark, f"{base}/in", schema, 2)

    def each(batch: DataFrame, number: int) -> None:
        batch.select("profile_id", "shard").write.mode("append").parquet(f"{base}/out")

    shards.drain(rows, each, f"{base}/state")
    return spark.read.schema("profile_id long, shard int").parquet(f"{base}/out")


QUERIES = {f.__name__: f for f in (inject_noise, gmm_fit, gmm_sample, vae_generate, vae_private_losses, dpm_sample, ancestral_sample, mia_discriminator, pca_2d, schedule_logsnr_steps, stream_profiles)}
