"""Golden values, metamorphic properties and error cases of the profile engine."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.functions import randoms
from loadweave.functions import schedule as S
from loadweave.functions import vectors as V
from loadweave.operators import attacks, diffusion, ecdf, etl, losses, mixture, networks, noise, ordering
from loadweave.sources import profiles as P
from loadweave.streaming import shards

READINGS = [("2012-10-12 00:30:00", "0.1"), ("2012-11-13 01:00:00", "0.2"), ("2012-12-14 01:30:00", "0.3"), ("2012-12-14 01:30:00", "0.3"), ("2013-01-15 02:00:00", "Null"), ("2013-01-15 02:30:00", "0.4"), ("2013-01-15 03:00:00", "0.5"), ("2013-01-15 03:30:00", "0.6")]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, "MAC000002", "Std", t, v, None) for i, (t, v) in enumerate(READINGS)]
    return spark.createDataFrame(rows, "reading_id int, LCLid string, stdorToU string, DateTime string, kwh string, ingested_at timestamp")


def test_golden_preprocessing(raw):
    f = etl.time_features(etl.clean_readings(raw)).orderBy("reading_id").collect()
    assert [str(r["week"]) for r in f] == ["2012-10-09", "2012-11-13", "2012-12-11", "2012-12-11"] + ["2013-01-15"] * 4
    assert [str(r["month_end"]) for r in f] == ["2012-10-31", "2012-11-30", "2012-12-31", "2012-12-31"] + ["2013-01-31"] * 4
    assert [r["month_max"] for r in f] == [31, 30, 31, 31, 31, 31, 31, 31]
    assert [r["dayofweek"] for r in f] == [4, 1, 4, 4, 1, 1, 1, 1]
    assert [r["settlement_period"] for r in f] == [2, 3, 4, 4, 5, 6, 7, 8]
    days = etl.daily_readings(raw)
    assert days.count() == 7 and days.agg(F.round(F.sum("kwh"), 6)).first()[0] == 2.1
    assert etl.complete_days(days, ["household", "date"], "kwh", 48).count() == 0
    packed = {str(r["date"]): r["kwh"] for r in etl.readings_to_profiles(raw, 4).collect()}
    assert packed == {"2013-01-15": [0.0, 0.4, 0.5, 0.6]}


def test_whole_profiles_keep_readings_without_id_or_tariff(spark):
    rows = [(i, None if i == 5 else "MAC000002", None if i % 7 == 0 or i >= 48 else "ToU", f"2013-01-{15 + i // 48} {i % 48 // 2:02d}:{30 * (i % 2):02d}:00", str(i), "f", None) for i in range(96)]
    raw = spark.createDataFrame(rows, "reading_id int, LCLid string, stdorToU string, DateTime string, kwh string, source_file string, ingested_at timestamp")
    got = {str(r["date"]): (r["household"], r["tariff"], r["kwh"]) for r in etl.whole_profiles(raw).collect()}
    assert got == {f"2013-01-{15 + k}": ("MAC000002", "ToU", [float(48 * k + i) for i in range(48)]) for k in (0, 1)}


def test_period_bounds_are_text(spark):
    df = spark.createDataFrame([("2013-12-31 00:00:00",), ("2013-12-30 23:30:00",), ("2014-01-01 00:00:00",), (None,)], "t string")
    assert [r[0] for r in df.select(etl.period(F.col("t"))).collect()] == [None, "historical", "future", None]
    assert df.select(etl.period(F.col("t"), True)).first()[0] == "historical"


def test_household_groups_overlap_only_if_few(spark):
    ids = spark.createDataFrame([(f"h{i}",) for i in range(10)] + [(None,)], "h string")
    got = ordering.household_groups(ids, "h", 7).groupBy("household_group").count().collect()
    assert {r[0]: r[1] for r in got} == {"train": 7, "holdout": 7}
    assert ordering.household_groups(ids, "h", 7, disjoint=True).select("h").distinct().count() == 10


def test_order_ranks_samples_batches(spark):
    df = spark.range(1000)
    pos = sorted(r["pos"] for r in ordering.shuffle_positions(df, "id").collect())
    assert pos == list(range(1, 1001))
    a = {r["id"] for r in ordering.exact_sample(df.repartition(7), "id", 37, seed=4).collect()}
    assert len(a) == 37 and a == {r["id"] for r in ordering.exact_sample(df.coalesce(1), "id", 37, seed=4).collect()}
    assert ordering.batches(df, "id", 300).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 300), (1, 300), (2, 300)]
    v = df.withColumn("v", F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 7).cast("double")))
    ranked = [r["id"] for r in ordering.value_ranks(v, "v", "id").orderBy("rank").collect()]
    want = sorted(range(1000), key=lambda i: (i % 10 == 0, -(i % 7) if i % 10 else 0, i))
    assert ranked == want
    with pytest.raises(ValueError):
        ordering.first_batch(df, "id", 1001)
    assert ordering.expand_by_weight(spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 1)], "i int, w int"), "w").count() == 3


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, None, 3.0],), (None,)], "v array<double>")
    z = V.standardise(F.col("v"), F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in df.select(z).collect()] == [[0.0, 0.5, 1.0], [0.0, None, 1.0], None]
    assert df.select(V.reconstruct(z, F.lit(1.0), F.lit(2.0))).first()[0] == [1.0, 2.0, 3.0]
    s = spark.createDataFrame([([9.0, 8.0, 0.5, 1.5],)], "v array<double>").select(*V.parse_sample(F.col("v"), 2, ["a", "b"])).first()
    assert (s["latent"], s["a"], s["b"]) == ([9.0, 8.0], 0, 2)
    m = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(V.split_channels(F.col("v"), 2).alias("c"))
    assert m.first()[0] == [[1.0, 2.0], [3.0, 4.0]] and m.select(V.flatten_channels(F.col("c"))).first()[0] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        V.sinusoidal_embedding(F.lit(1.0), 5)
    with pytest.raises(TypeError):
        V.as_column_vector(F.lit("x"), "string")


def test_golden_losses(spark):
    df = spark.createDataFrame([([float(p)], [float(r)], w) for p, r, w in zip([2, 3, 4, 5, 6], [1, 1, 1, 2, 3], [1, 1, 3, 1, 2])], "p array<double>, r array<double>, w int")
    got = df.agg(*[losses.quantile_loss(df, "p", "r", q) for q in (0.3, 0.5, 0.9)], losses.quantile_loss(df, "p", "r", 0.5, "w"), losses.mse_loss(df, "p", "r", "w")).first()
    assert list(got) == pytest.approx([1.68, 1.2, 0.24, 1.3125, 7.375])


def test_weighted_discrepancy_equals_expanded(spark):
    rng = random.Random(0)
    rows = [(i, 0, i % 2, [rng.random(), rng.random()], 1 + i // 2 % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, b int, s int, v array<double>, w int")
    weighted = losses.mmd(df, "b", "s", "v", "k", "w").first()["mmd"]
    expanded = ordering.expand_by_weight(df, "w").withColumn("k", F.col("k") * 10 + F.col("copy"))
    assert weighted == pytest.approx(losses.mmd(expanded, "b", "s", "v", "k").first()["mmd"])
    assert losses.mmd(df.where("k > 0"), "b", "s", "v", "k").first()["mmd"] is None


def test_calibration(spark):
    a = ecdf.long_form(spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(9)], "id int, v array<double>"), "id", "v")
    assert all(r["x"] == r["calibrated"] for r in ecdf.calibrate(a, a, "id").collect())
    b = ecdf.long_form(spark.createDataFrame([(i, [float(i * 10), 0.0]) for i in range(5)], "id int, v array<double>"), "id", "v")
    got = {r["id"]: r["calibrated"] for r in ecdf.calibrate(a, b, "id").where("pos = 0").collect()}
    assert [got[i] for i in range(5)] == [float(r * 9 // 5 - 1) for r in range(1, 6)]
    assert ecdf.cdf(ecdf.fit(a, "id")).agg(F.max("cdf"), F.min("cdf")).first()[0] == 1.0


def test_attack_frames_and_metrics(spark):
    def part(lo):
        return spark.createDataFrame([(i, [float(i)]) for i in range(lo, lo + 10)], "id int, v array<double>")

    t = attacks.attack_train_set(part(10), part(0))
    assert {(r["target"], r["id"] < 10) for r in t.collect()} == {(1, True), (0, False)}
    a = attacks.attack_set(part(30), part(50), part(40))
    assert {(r["type"], r["target"]) for r in a.collect()} == {("seen", 1), ("unseen_same", 0), ("unseen_diff", 0)}
    scores = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, 0), (3, 0.5, 1), (4, 0.1, 0)], "k int, s double, y int")
    m = attacks.attack_metrics(attacks.rank_predictions(scores, "s", "y", "k"), "y").first()
    assert (m["tp"], m["fp"], m["precision"], m["accuracy"]) == (1, 1, 0.5, 0.5) and m["interval"] == pytest.approx(1.96 * math.sqrt(0.25 / 4))
    near = attacks.nearest_ratio(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<double>"), spark.createDataFrame([(1, [3.0, 3.0]), (2, [9.0, 9.0])], "id int, v array<double>"))
    assert {r[0]: r[1] for r in near.collect()} == {1: pytest.approx(0.2), 2: None}


def test_mixture(spark):
    x = np.repeat([[1.0, 1, 1], [1.1] * 3, [1.2] * 3, [1.1] * 3, [200.0] * 3, [210.0] * 3, [220.0] * 3, [230.0] * 3], 1, axis=0)
    eye = 0.01 * np.eye(3)
    m = mixture.Mixture(np.array([0.1, 0.9]), np.array([[1.0] * 3, [200.0] * 3]), np.stack([np.eye(3) * 1e4] * 2), np.stack([eye, eye]))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    assert [r["component"] for r in mixture.score(df, "i", "v", m).orderBy("i").collect()] == [0] * 4 + [1] * 4
    fitted = mixture.fit(df, "v", 2, reg=1e-2, rounds=5)
    assert sorted(fitted.weights.tolist()) == pytest.approx([0.5, 0.5]) and mixture.positive_definite(fitted.covariances)
    again = mixture.Mixture.read(fitted.table(spark))
    assert np.allclose(again.means, fitted.means)
    drawn = mixture.sample(spark, mixture.Mixture(np.array([0.1, 0.9]), np.array([[0.0], [1000.0]]), np.full((2, 1, 1), 0.01), np.full((2, 1, 1), 10.0)), 1000)
    n = {r["component"]: r["n"] for r in mixture.component_counts(drawn, 3).collect()}
    assert round(n[0] / 1000, 1) == 0.1 and n[2] == 0
    with pytest.raises(ValueError):
        mixture.precision_cholesky(np.array([[[1.0, 2.0], [2.0, 1.0]]]))
    with pytest.raises(ValueError):
        mixture.initial(df, "v", 2, method="random")
    with pytest.raises(KeyError):
        mixture.in_range(df, {"nope": (0, 1)})


def test_likelihood_never_falls_and_weights_equal_copies(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(4, 1, (40, 2))])
    df = spark.createDataFrame([(i, r.tolist(), 1 + i % 2) for i, r in enumerate(x)], "i int, v array<double>, w int").cache()
    m, last = mixture.initial(df, "v", 2, weight="w"), float("inf")
    other = mixture.initial(ordering.expand_by_weight(df, "w"), "v", 2)
    assert np.allclose(np.sort(m.weights), np.sort(other.weights), atol=1e-2)
    for _ in range(4):
        m = mixture.em_round(df, "v", m, 1e-6, "w")
        assert m.nll <= last + 1e-9
        last = m.nll


def test_noise(spark):
    df = spark.createDataFrame([(i, [0.0] * 4) for i in range(200)], "id long, v array<double>")
    out = noise.create_outliers(df, "id", "v", 0.5, n_each=50, width=4).collect()
    assert len(out) == 100 and {r["segment"] for r in out} == {"gaussian", "gamma"} and all(len(r["v"]) == 4 for r in out)
    assert abs(np.mean([r["v"] for r in out if r["segment"] == "gamma"]) - 10) < 1
    assert not noise.noise_rows("gamma", np.array([1, 2]), 0.0, 20, 1, 3, 0).any()
    with pytest.raises(ValueError):
        noise.inject_noise(df, "id", "v", "uniform", 1, 0.1)


def test_schedules(spark):
    for kind in ("linear", "cosine"):
        b = S.betas(kind, 100)
        assert ((b >= 0) & (b <= 0.9999)).all() and (np.diff(b) >= -1e-12).all() and b[0] < 1.1e-3
        t = [r["beta"] for r in S.beta_table(spark, kind, 100).orderBy("t").collect()]
        assert np.allclose(t, b)
    with pytest.raises(ValueError):
        S.betas("discrete", 10)
    for kind, kw in ((S.Schedule.LINEAR, {}), (S.Schedule.COSINE, {}), (S.Schedule.DISCRETE, {"alphas_bar": np.cumprod(1 - S.betas("cosine", 50))})):
        ns = S.NoiseSchedule(kind, **kw)
        t = np.linspace(0.05, 0.95, 9)
        assert np.allclose(ns.inverse_lam(ns.lam(t)), t, atol=1e-6)
    for steps in range(3, 30):
        for order in (1, 2, 3):
            assert sum(S.single_step_orders(steps, order)) == steps
    with pytest.raises(ValueError):
        S.time_steps(S.NoiseSchedule(S.Schedule.LINEAR), "cubic", 1, 0.1, 3)


def test_autoencoder_gradients_and_training(spark):
    c = networks.AutoencoderConfig(input_dim=5, class_dim=1, latent_dim=3, hidden=(6,))
    net = networks.Autoencoder.fresh(c, 1)
    rng = np.random.default_rng(0)
    x, f, e = rng.normal(size=(4, 5)), rng.normal(size=(4, 1)), rng.normal(size=(4, 3))
    _, g = net.gradients(x, f, e)
    for name in ("e0.w", "mu.w", "sigma.b", "d1.w"):
        at = (0,) * net.p[name].ndim
        old, h = net.p[name][at], 1e-5
        net.p[name][at] = old + h
        up = net.gradients(x, f, e)[0]
        net.p[name][at] = old - h
        down = net.gradients(x, f, e)[0]
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=1e-4)
    _, small = net.gradients(x[:1], f[:1], e[:1], clip=0.01)
    assert math.sqrt(sum((v * v).sum() for v in small.values())) <= 0.0101
    df = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(rng.normal(size=(50, 5)))], "id long, v array<double>, a int")
    trained, curve = networks.train(df, "id", "v", ["a"], c, epochs=12, rate=1e-2)
    assert curve[-1] < curve[0]
    z = networks.encode(df, "id", "v", ["a"], trained)
    assert len(z.first()["z"]) == 4
    with pytest.raises(ValueError):
        networks.train(df, "id", "v", ["a"], c, private=(8.0, 0.01, 2.0))
    assert networks.epsilon_spent(1.0, 1.0, 10, 1e-5) > networks.epsilon_spent(4.0, 1.0, 10, 1e-5)
    assert networks.epsilon_spent(networks.noise_for(8, 1e-4, 1.0, 5), 1.0, 5, 1e-4) <= 8
    assert networks.cosine_rate(1.0, 0, 10) == 1.0 and networks.cosine_rate(1.0, 10, 10) == pytest.approx(0.2)


def test_training_takes_many_steps_on_the_whole_loss(spark):
    rng = np.random.default_rng(2)
    x, out = rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    pairs = [(i, 0, side, r.tolist()) for side, m in enumerate((out, x)) for i, r in enumerate(m)]
    df = spark.createDataFrame(pairs, "k int, b int, s int, v array<double>").withColumn("k", F.col("k") * 2 + F.col("s"))
    net = networks.Autoencoder.fresh(networks.AutoencoderConfig(input_dim=3, mse=0.0, quantiles=()))
    assert net.loss_and_slope(out, x)[0] == pytest.approx([losses.mmd(df, "b", "s", "v", "k").first()["mmd"]] * 5)
    rows = [(i, [a, a, -a, 2 * a], i % 3) for i, a in enumerate(rng.normal(size=1500).tolist())]
    data = spark.createDataFrame(rows, "id long, v array<double>, a int")
    c = networks.AutoencoderConfig(input_dim=4, class_dim=1, latent_dim=2, hidden=(16,))
    for args in ({}, {"worker_batches": 15}):
        trained, curve = networks.train(data, "id", "v", ["a"], c, epochs=6, rate=1e-2, batch_rows=50, **args)
        assert curve[-1] < 0.3 * curve[0]
    again, _ = networks.train(data.repartition(3), "id", "v", ["a"], c, epochs=6, rate=1e-2, batch_rows=50, worker_batches=15)
    assert all((again.p[k] == trained.p[k]).all() for k in trained.p)
    _, private = networks.train(data, "id", "v", ["a"], c, epochs=6, rate=1e-2, batch_rows=50, private=(8.0, 1e-3, 1.0))
    assert private[-1] < private[0]


def test_denoiser_and_solvers(spark):
    for conv in (True, False):
        net = networks.Denoiser.fresh(seed=1, width=8, heads=2, layers=2, feed=16, convolve=conv)
        assert net(np.zeros((3, 12, 1)), np.array([0.0, 1.0, 2.0])).shape == (3, 12, 1)
    # for data that are one point the perfect noise model is known, and every solver must end at the point
    steps, point = 200, 0.7
    bar = np.cumprod(1 - S.betas("cosine", steps))

    def model(x, t):
        ns = S.NoiseSchedule(S.Schedule.DISCRETE, bar)
        at = t[0] / steps + 1 / steps
        return (x - float(ns.alpha(at)) * point) / float(ns.sigma(at))

    d = diffusion.Diffusion(model, steps=steps)
    x = np.random.default_rng(0).normal(size=(5, 8, 1))
    for method in ("multistep", "singlestep", "singlestep_fixed", "adaptive"):
        for order in (1, 2, 3):
            for start in (True, False):
                out = diffusion.Solver(d, predict_start=start).sample(x, 15, order, method, end=0.01)
                assert np.abs(out - point).max() < 0.2, (method, order, start)
    assert np.abs(diffusion.Solver(d).denoise(x, 0.5) - point).max() < 1e-6
    for last in d.ancestral(x, np.random.default_rng(1)):
        pass
    assert np.abs(last - point).max() < 0.2
    assert np.abs(diffusion.dynamic_threshold(np.array([[5.0, 0.1]]))).max() <= 1
    with pytest.raises(NotImplementedError):
        diffusion.Diffusion(model, variance=S.Variance.LEARNED_RANGE)
    with pytest.raises(ValueError):
        diffusion.Solver(d).sample(x, method="euler")
    got = diffusion.generate(spark, diffusion.Diffusion(networks.Denoiser.fresh(seed=1, width=8, heads=2, layers=1, feed=16), steps=30), 7, 12, steps=15).collect()
    assert sorted(r["id"] for r in got) == list(range(7)) and all(len(r["v"]) == 12 for r in got)


def test_solver_forms_agree_in_the_limit():
    """With small steps both forms approach the exact flow of a model whose solution is known, the higher order faster."""
    steps = 500
    bar = np.cumprod(1 - S.betas("cosine", steps))

    def model(x, t):  # data of unit variance: the start seen from x is alpha x, so x keeps its length
        at = t[0] / steps + 1 / steps
        return float(S.NoiseSchedule(S.Schedule.DISCRETE, bar).sigma(at)) * x

    d, x = diffusion.Diffusion(model, steps=steps), np.random.default_rng(0).normal(size=(4, 6, 1))
    error = {}
    for form in ("solver", "taylor"):
        for start in (True, False):
            for method, order, n in (("singlestep_fixed", 1, 60), ("singlestep_fixed", 2, 60), ("singlestep_fixed", 3, 60), ("multistep", 2, 60)):
                out = diffusion.Solver(d, predict_start=start, form=form).sample(x, n, order, method, grid="logSNR", end=0.02)
                error[form, start, method, order] = np.abs(out - x).max()
    for (form, start, method, order), e in error.items():
        if order > 1:
            assert e < 0.3 * error[form, start, "singlestep_fixed", 1], (form, start, method, order, e)
    assert error["solver", True, "singlestep_fixed", 2] != error["taylor", True, "singlestep_fixed", 2]
    with pytest.raises(ValueError):
        diffusion.Solver(d, form="other")


def test_guidance_and_scores():
    bar, x, t = np.linspace(0.9, 0.1, 10), np.ones((2, 3, 1)), np.array([2.0, 7.0])
    sigma = np.sqrt(1 - bar[[2, 7]])[:, None, None]
    assert np.allclose(diffusion.noise_of_score(lambda x, t: -x / 2, bar)(x, t), sigma * x / 2)
    by_class = lambda x, t, c: x * (3.0 if c == "a" else 1.0)
    assert np.allclose(diffusion.guided_by_condition(by_class, "a", 2.0, "none")(x, t), 5.0) and np.allclose(diffusion.guided_by_condition(by_class, "a")(x, t), 3.0)
    assert np.allclose(diffusion.guided_by_classifier(lambda x, t: x, lambda x, t: 4 * x, bar, 0.5)(x, t), x - 2 * sigma)


def test_networks_are_saved_and_read(spark, tmp_path):
    c = networks.AutoencoderConfig(input_dim=5, class_dim=1, latent_dim=3, hidden=(6,))
    own = networks.AutoencoderConfig(input_dim=5, class_dim=1, latent_dim=3, hidden=(6,), decoder_hidden=(4, 7))
    assert networks.Autoencoder.fresh(own).p["d2.w"].shape == (4, 7) and networks.Autoencoder.fresh(own).decode(np.zeros((2, 3)), np.zeros((2, 1))).shape == (2, 5)
    for net in (networks.Autoencoder.fresh(c, 1), networks.Autoencoder.fresh(own, 1), networks.Denoiser.fresh(seed=1, width=8, heads=2, layers=1, feed=16)):
        networks.save_network(net, spark, f"{tmp_path}/{type(net).__name__}")
        again = networks.load_network(spark, f"{tmp_path}/{type(net).__name__}")
        assert type(again) is type(net) and again.p.keys() == net.p.keys() and all((again.p[k] == net.p[k]).all() for k in net.p)
        assert getattr(again, "config", None) == getattr(net, "config", None) and getattr(again, "heads", None) == getattr(net, "heads", None)
    df = spark.createDataFrame([(i, [0.1 * i] * 5, i % 3, i + 1) for i in range(6)], "id long, v array<double>, a int, w int")
    net = networks.Autoencoder.fresh(c, 1)
    got = {r["id"]: r["w"] for r in networks.encode(df, "id", "v", ["a"], net, weight="w").collect()}
    assert got == {i: i + 1 for i in range(6)}
    with pytest.raises(KeyError):
        networks.encode(df, "id", "v", ["a"], net, weight="none")


def test_shards_are_read_exactly(spark, tmp_path):
    P.write_shards(spark.range(103).withColumnRenamed("id", "profile_id"), f"{tmp_path}/s", "profile_id", 4)
    assert P.read_shards(spark, f"{tmp_path}/s", subsample=0.5).count() == 51
    batches = P.read_shards(spark, f"{tmp_path}/s", batch=20, drop_last=True)
    assert batches.count() == 100 and batches.select("batch_id").distinct().count() == 5
    assert P.read_shards(spark, f"{tmp_path}/s", batch=20).count() == 103
    assert sorted(r["pos"] for r in P.read_shards(spark, f"{tmp_path}/s", shuffle=True).collect()) == list(range(1, 104))


def test_sources_and_streams(spark, tmp_path):
    df = spark.range(103).withColumn("kwh", F.array(F.col("id").cast("double"), F.lit(0.5)))
    sizes = sorted(r["count"] for r in P.shard_assignment(df, "id", 5).groupBy("shard").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    P.write_shards(df, str(tmp_path / "s"), "id", 5)
    assert P.read_shards(spark, str(tmp_path / "s")).count() == 103
    seen = []
    stream = shards.stream_profiles(spark, str(tmp_path / "s"), spark.read.parquet(str(tmp_path / "s")).schema, 2)
    shards.drain(stream, lambda b, n: seen.append(b.count()), str(tmp_path / "state"))
    assert sum(seen) == 103 and len(seen) >= 3
    P.write_profiles_csv(df, str(tmp_path / "c"))
    back = P.read_profiles_csv(spark, str(tmp_path / "c"), "id long, kwh string")
    assert back.exceptAll(df).count() == 0 and back.count() == 103
    (tmp_path / "r.csv").write_text("LCLid,stdorToU,DateTime,KWH/hh (per half hour) \nMAC1,Std,2013-01-01 00:00:00,0.2\n")
    assert P.read_readings_csv(spark, str(tmp_path / "r.csv")).first()["kwh"] == "0.2"


def test_plan_shapes(raw):
    plan = etl.readings_to_profiles(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(household") <= 4 and "CartesianProduct" not in plan


def test_counter_based_draws():
    ids = np.arange(-5, 20_000)
    n = randoms.normals(ids, 5, seed=3)
    assert abs(n.mean()) < 0.01 and abs(n.std() - 1) < 0.01 and (n[7:9] == randoms.normals(ids[7:9], 5, seed=3)).all()
    assert abs(np.corrcoef(n[:, 0], n[:, 4])[0, 1]) < 0.03 and abs(np.corrcoef(n[:, 0], randoms.normals(ids, 5, seed=4)[:, 0])[0, 1]) < 0.03
    for shape in (0.4, 2.0, 12.0):
        g = randoms.gammas(ids, 3, shape)
        assert g.min() > 0 and g.mean() == pytest.approx(shape, rel=0.03) and g.var() == pytest.approx(shape, rel=0.06)


def test_clipped_gradients_equal_a_loop_over_rows():
    c = networks.AutoencoderConfig(input_dim=5, class_dim=1, latent_dim=3, hidden=(6,))
    net, rng = networks.Autoencoder.fresh(c, 1), np.random.default_rng(0)
    x, f, e = rng.normal(size=(30, 5)), rng.normal(size=(30, 1)), rng.normal(size=(30, 3))
    loss, g = net.gradients(x, f, e, clip=0.7)
    total, want = 0.0, dict.fromkeys(g, 0.0)
    for i in range(30):
        one, gi = net.gradients(x[i : i + 1], f[i : i + 1], e[i : i + 1])
        scale = min(1.0, 0.7 / math.sqrt(sum((v * v).sum() for v in gi.values())))
        total, want = total + one, {k: want[k] + scale * v for k, v in gi.items()}
    assert loss == pytest.approx(total) and all(np.allclose(g[k], want[k]) for k in g)


def test_ranks_of_frequent_values_and_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 11 == 0 else (1.0 if i % 3 else float(round(rng.random(), 2)))) for i in rng.permutation(1500).tolist()]
    df = spark.createDataFrame(rows, "id long, v double")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r["id"]: r["rank"] for r in ordering.value_ranks(df, "v", "id", buckets=16).collect()} == {r[0]: i + 1 for i, r in enumerate(order)}
    assert {r["id"]: r["pos"] for r in ordering.key_positions(df, "id", buckets=7).collect()} == {i: i + 1 for i in range(1500)}


def test_running_counts_and_slots_with_one_frequent_value(spark):
    rng = np.random.default_rng(9)
    values = np.where(rng.random((300, 3)) < 0.6, 0.0, rng.normal(size=(300, 3)).round(2))
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(values)], "id long, v array<double>, g string")
    fitted = {(r["pos"], r["k"]): r["x"] for r in ecdf.fit(ecdf.long_form(df, "id", "v"), "id").collect()}
    assert fitted == {(j, k + 1): x for j in range(3) for k, x in enumerate(np.sort(values[:, j]).tolist())}
    stats = {r["pos"]: r for r in losses.profile_stats(df, "v", "g").collect()}
    for j in range(3):
        assert stats[j]["median"] == pytest.approx(np.median(values[:, j])) and stats[j]["p95"] == pytest.approx(np.percentile(values[:, j], 95)) and stats[j]["mean"] == pytest.approx(values[:, j].mean())
