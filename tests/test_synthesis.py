"""The training source, the synthesiser, the attack builders and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.operators import etl, networks, synthesis


@pytest.fixture(scope="module")
def source(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.gamma(2, 0.1, 6).tolist(), i % 12 + 1, i % 7) for i in range(120)]
    p = spark.createDataFrame(rows, "profile_id long, kwh array<double>, month int, dayofweek int")
    out = spark.createDataFrame([(900 + i, [9.0] * 6, 1, 1, "gamma") for i in range(3)], "profile_id long, kwh array<double>, month int, dayofweek int, segment string")
    return synthesis.ProfileSource(p, 0.2, 0.1, outliers=out)


def test_source(source):
    assert source.train(50).count() == 53 and source.train().where("segment = 'gamma'").first()["kwh"] == pytest.approx([88.0] * 6)
    assert source.real_sample(3, outliers=True).first()["kwh"] == pytest.approx([9.0] * 6)
    with pytest.raises(ValueError):
        source.real_sample(121)
    with pytest.raises(ValueError):
        synthesis.ProfileSource(source.profiles, 0.2, 0.1).outlier_rows()


def test_synthesizer(source):
    config = networks.AutoencoderConfig(input_dim=6, latent_dim=2, hidden=(8,))
    model = synthesis.MixtureSynthesizer(config, components=2, epochs=2, rounds=2).fit(synthesis.ProfileSource(source.profiles, 0.2, 0.1))
    rows = model.sample(200).collect()
    assert 0 < len(rows) <= 200 and all(len(r["kwh"]) == 6 and min(r["kwh"]) >= 0 and 1 <= r["month"] <= 12 and 0 <= r["dayofweek"] <= 6 for r in rows)
    assert rows[0]["kwh"] == {r["id"]: r["kwh"] for r in model.sample(200).collect()}[rows[0]["id"]]
    with pytest.raises(ValueError):
        model.sample(5, features=("dayofweek", "month"))
    with pytest.raises(ValueError):
        synthesis.MixtureSynthesizer(config).sample(5)


def test_attack_roles(source, spark):
    synthetic = source.profiles.select(F.col("profile_id").alias("id"), "kwh")
    roles = synthesis.attack_samples(source, source.profiles, synthetic, 40, 10, width=6)
    assert {k: v.count() for k, v in roles.items()} == {"synthetic": 120, "train": 40, "holdout": 40, "seen": 3, "unseen_same": 20, "unseen_diff": 20}


def test_preprocess_writes_partitions(spark, tmp_path):
    rows = [(i, f"MAC{h:06d}", "Std", f"2013-0{1 + m}-05 {s // 2:02d}:{30 * (s % 2):02d}:00", "0.5", None) for i, (h, m, s) in enumerate((h, m, s) for h in range(4) for m in range(2) for s in range(48))]
    raw = spark.createDataFrame(rows, "reading_id int, LCLid string, stdorToU string, DateTime string, kwh string, ingested_at timestamp")
    etl.preprocess(raw, str(tmp_path), sample_size=2)
    p = spark.read.parquet(str(tmp_path / "profiles"))
    assert p.count() == 8 and {(r["period"], r["household_group"]) for r in p.collect()} == {("historical", "train"), ("historical", "holdout")}
    assert spark.read.parquet(str(tmp_path / "stats")).first()["mean"] == 0.5
