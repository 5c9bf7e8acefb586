"""Queries of the smaller operators: filters, semi-joins, counts, layouts, solver plans, attack builders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions import randoms
from loadweave.functions import schedule as S
from loadweave.functions import vectors as V
from loadweave.operators import attacks, diffusion, etl, mixture, networks, noise, synthesis
from loadweave.plans.profiles import _BAR, _GM, _LIN, _QS, _RANK, PR, RD, RDW, _fixed_mixture, _noised, _points, _ranked, profiles, r6, readings, whole_readings
from loadweave.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def q(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


@q("SELECT LCLid, date FROM (SELECT LCLid, date, NULL AS segment FROM lcl_profiles UNION ALL SELECT LCLid, date, segment FROM lcl_outliers) WHERE segment IS NULL")
def null_segment(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lcl_profiles").select("LCLid", "date")
    return a.unionByName(table(spark, d, "lcl_outliers").select("LCLid", "date", "segment"), allowMissingColumns=True).where("segment is null").select("LCLid", "date")


@q(f"WITH {RD} SELECT DISTINCT household FROM rd")
def distinct_households(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("household").distinct()


@q(f"WITH {RD} SELECT count(*) AS n FROM rd WHERE household IN (SELECT upper(trim(LCLid)) FROM household_register)")
def readings_of_register(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "household_register").select(F.upper(F.trim("LCLid")).alias("household")).distinct()
    return readings(spark, d).join(known, "household", "left_semi").agg(F.count("*").alias("n"))


@q(f"WITH {RDW} SELECT DISTINCT household FROM rd")
def distinct_households_whole(spark: SparkSession, d: str) -> DataFrame:
    return whole_readings(spark, d).select("household").distinct()


@q(f"WITH {RDW} SELECT count(*) AS n FROM rd WHERE household IN (SELECT upper(trim(LCLid)) FROM household_register)")
def readings_of_register_whole(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "household_register").select(F.upper(F.trim("LCLid")).alias("household")).distinct()
    return whole_readings(spark, d).join(known, "household", "left_semi").agg(F.count("*").alias("n"))


@q(f"WITH {RD} SELECT count(*) AS n FROM (SELECT household, date, count(*) AS c FROM (SELECT DISTINCT household, CAST(dt AS DATE) AS date, hour(dt) * 2 + CASE WHEN minute(dt) >= 30 THEN 1 ELSE 0 END AS sp FROM rd) GROUP BY ALL) WHERE c = 49")
def complete_days_49_empty(spark: SparkSession, d: str) -> DataFrame:
    """A day has 48 half-hours, so asking for 49 finds none."""
    return etl.complete_days(etl.daily_readings(table(spark, d, "lcl_data")), ["household", "date"], "kwh", 49).agg(F.count("*").alias("n"))


@q(f"WITH {_RANK} SELECT round(avg(CASE WHEN y = rank_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r")
def binary_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).agg(r6(attacks.accuracy(F.col("rank_pred"), F.col("y"))).alias("accuracy"))


@q(f"WITH {PR} SELECT profile_id, [kwh[1:24], kwh[25:48]] AS halves FROM pr")
def channel_layout(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("profile_id", V.split_channels(F.col("kwh"), 2).alias("halves"))


@q(f"WITH {_QS}, y AS (SELECT *, profile_id % 100 AS t FROM x), z AS (SELECT y.profile_id, y.x0, y.e, c.beta, c.bar AS a, c.prev AS p FROM y JOIN c ON c.t = y.t) SELECT profile_id, list_transform(range(1, 49), lambda i: round(beta * sqrt(p) / (1 - a) * x0[i] + (1 - p) * sqrt(1 - beta) / (1 - a) * e[i], 6)) AS mean FROM z")
def q_posterior(spark: SparkSession, d: str) -> DataFrame:
    c = {k: F.col(k) for k in ("posterior_mean_x0", "posterior_mean_xt")}
    return _noised(spark, d).select("profile_id", V.rounded(S.q_posterior_mean("x0", "e", c)).alias("mean"))


@q(f"WITH {_LIN}, {_BAR} SELECT t, round(sqrt(bar), 9) AS mean_factor, round(1 - bar, 9) AS variance, round(ln(1 - bar), 6) AS log_variance FROM c")
def q_mean_variance(spark: SparkSession, d: str) -> DataFrame:
    c = S.coefficient_table(S.beta_table(spark, "linear", 100))
    return c.select("t", F.round("sqrt_alpha_bar", 9).alias("mean_factor"), F.round(1 - F.col("alpha_bar"), 9).alias("variance"), r6("log_one_minus").alias("log_variance"))


@q("SELECT 0 AS component, 0 AS zero_mean UNION ALL SELECT 1, 0")
def zero_mean_components(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("mean", F.lit(0.0), lambda s, x: s + x)
    return _fixed_mixture().table(spark).select("component", F.when(total == 0, 1).otherwise(0).alias("zero_mean"))


@q("SELECT CAST(steps AS INTEGER) AS steps, CAST(steps // 3 + 1 AS INTEGER) AS parts, steps AS evaluations FROM (SELECT unnest(range(4, 41)) AS steps)")
def single_step_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, len(S.single_step_orders(n, 3)), sum(S.single_step_orders(n, 3))) for n in range(4, 41)]
    return spark.createDataFrame(rows, "steps int, parts int, evaluations long")


@q(f"WITH {_GM} SELECT CASE WHEN l0 >= l1 THEN 0 ELSE 1 END AS component, count(*) AS n FROM r GROUP BY 1")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return mixture.component_counts(mixture.score(_points(spark, d), "profile_id", "v", _fixed_mixture()), 2)


@q(f"WITH {PR}, p AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(profile_id AS VARCHAR) || '|0'), profile_id) AS pos FROM pr) SELECT profile_id, list_transform(kwh, lambda x: round(greatest(x, 0), 6)) AS kwh FROM p WHERE pos <= 200")
def draw_real(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "mean_std").first()
    return synthesis.ProfileSource(profiles(spark, d), s["mean"], s["stdev"]).real_sample(200).select("profile_id", V.rounded(F.col("kwh")).alias("kwh"))


@q()
def synthesizer(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "mean_std").first()
    source = synthesis.ProfileSource(profiles(spark, d), s["mean"], s["stdev"])
    model = synthesis.MixtureSynthesizer(networks.AutoencoderConfig(latent_dim=4, hidden=(32, 16)), components=3, epochs=3, rounds=3).fit(source)
    return model.sample(500).select("id", V.rounded(F.col("kwh")).alias("kwh"), "month", "dayofweek")


@q(f"""WITH {PR} SELECT 'synthetic' AS role, count(*) AS n FROM pr UNION ALL SELECT 'train', least(100, count(*)) FROM pr WHERE split = 'train' UNION ALL SELECT 'holdout', least(100, count(*)) FROM pr WHERE split <> 'train'
UNION ALL SELECT 'seen', count(*) FROM lcl_outliers UNION ALL SELECT unnest(['unseen_same', 'unseen_diff']), 2 * least(20, n) FROM (SELECT count(*) AS n FROM pr WHERE split <> 'train')""")
def attack_roles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "mean_std").first()
    p, seen = profiles(spark, d), table(spark, d, "lcl_outliers").withColumn("profile_id", F.xxhash64("LCLid", "date"))
    source = synthesis.ProfileSource(p.where("split = 'train'"), s["mean"], s["stdev"], outliers=seen.select("profile_id", "kwh", "month", "dayofweek", "segment"))
    roles = synthesis.attack_samples(source, p.where("split <> 'train'"), p.select(F.col("profile_id").alias("id"), "kwh"), 100, 20)
    out = None
    for name, df in roles.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("role"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- networks and reverse steps at fixed parameters
_SMALL = networks.AutoencoderConfig(input_dim=4, class_dim=2, latent_dim=2, hidden=(3,))


def _fixed_autoencoder() -> networks.Autoencoder:
    """Weights by rule; the scale head is zero, so encoding adds no noise."""
    net = networks.Autoencoder.fresh(_SMALL)
    for at, name in enumerate(sorted({k[:-2] for k in net.p})):
        a, b = net.p[f"{name}.w"].shape
        scale = 0.0 if name == "sigma" else 0.1
        net.p[f"{name}.w"] = scale * np.array([[(7 * i + 3 * j + 5 * at) % 11 - 5 for j in range(b)] for i in range(a)], float)
        net.p[f"{name}.b"] = scale * np.array([(2 * j + at) % 5 - 2 for j in range(b)], float)
    return net


def _layer_sql(net: networks.Autoencoder, name: str, x: str, active: bool) -> str:
    """A linear layer over the list x, with the activation where there is one."""
    w, b = net.p[f"{name}.w"], net.p[f"{name}.b"]
    z = "[" + ", ".join(" + ".join([f"{b[j]!r}", *(f"{w[i, j]!r} * {x}[{i + 1}]" for i in range(len(w)))]).replace("np.float64(", "").replace(")", "") for j in range(len(b))) + "]"
    if not active:
        return z
    t = "(1 / (1 + 0.3275911 * abs(z) / sqrt(2)))"
    erf = f"sign(z) * (1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-z * z / 2))"
    return f"list_transform({z}, lambda z: 0.5 * z * (1 + {erf}))"


def _chain_sql(net: networks.Autoencoder, names: list[str], first: str) -> str:
    """Common table expressions l0, l1, ... over a table `first` with profile_id, f and the list x."""
    out, before = [], first
    for i, (name, active) in enumerate(names):
        out.append(f"l{i} AS (SELECT profile_id, f, {_layer_sql(net, name, 'x', active)} AS x FROM {before})")
        before = f"l{i}"
    return ", ".join(out)


_NET = _fixed_autoencoder()
_NET_IN = f"{PR}, i AS (SELECT profile_id, [CAST(month AS DOUBLE), CAST(dayofweek AS DOUBLE)] AS f, [kwh[1], kwh[13], kwh[25], kwh[37], CAST(month AS DOUBLE), CAST(dayofweek AS DOUBLE)] AS x FROM pr WHERE month IS NOT NULL AND dayofweek IS NOT NULL)"
_NET_OUT = f"{PR}, i AS (SELECT profile_id, [] AS f, [kwh[1], kwh[13], CAST(month AS DOUBLE), CAST(dayofweek AS DOUBLE)] AS x FROM pr WHERE month IS NOT NULL AND dayofweek IS NOT NULL)"


def _net_input(spark: SparkSession, d: str, at: tuple[int, ...]) -> DataFrame:
    return profiles(spark, d).where("month is not null and dayofweek is not null").select("profile_id", F.array(*[F.col("kwh")[i] for i in at]).alias("v"), "month", "dayofweek")


@q(f"WITH {_NET_IN}, {_chain_sql(_NET, [('e0', True), ('e1', False), ('mu', False)], 'i')} SELECT profile_id AS id, list_transform(list_concat(x, f), lambda v: round(v, 6)) AS z FROM l2")
def vae_encode_fixed(spark: SparkSession, d: str) -> DataFrame:
    z = networks.encode(_net_input(spark, d, (0, 12, 24, 36)), "profile_id", "v", ["month", "dayofweek"], _NET)
    return z.select("id", V.rounded(F.col("z")).alias("z"))


@q(f"WITH {_NET_OUT}, {_chain_sql(_NET, [('d0', True), ('d1', True), ('d2', False)], 'i')} SELECT profile_id AS id, list_transform(x, lambda v: round(v, 6)) AS v FROM l2")
def vae_decode_fixed(spark: SparkSession, d: str) -> DataFrame:
    out = networks.decode(_net_input(spark, d, (0, 12)), "profile_id", "v", ["month", "dayofweek"], _NET)
    return out.select("id", V.rounded(F.col("v")).alias("v"))


def _half(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A stand-in for a model: half its input."""
    return 0.5 * x


class _NoNoise:
    @staticmethod
    def normal(size: tuple[int, ...]) -> np.ndarray:
        return np.zeros(size)


def _by_batch(spark: SparkSession, d: str, f: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(np.stack(b.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), pa.list_(pa.float64())) for v in out.values())], names=["profile_id", *out])

    return profiles(spark, d).select("profile_id", "kwh").mapInArrow(run, f"profile_id long, {schema}")


_AT = f"{PR}, {_LIN}, {_BAR}, k AS (SELECT bar AS a, prev AS p, beta AS b FROM c WHERE t = 40)"
_EACH = "list_transform(kwh, lambda x: round({}, 6))"


@q(f"""WITH {_AT} SELECT profile_id, {_EACH.format("0.5 * x")} AS noise_n, {_EACH.format("(x - sqrt(1 - a) * 0.5 * x) / sqrt(a)")} AS start_n,
{_EACH.format("(x - sqrt(a) * 0.5 * x) / sqrt(1 - a)")} AS noise_x, {_EACH.format("0.5 * x")} AS start_x,
{_EACH.format("sqrt(1 - a) * x + sqrt(a) * 0.5 * x")} AS noise_v, {_EACH.format("sqrt(a) * x - sqrt(1 - a) * 0.5 * x")} AS start_v FROM pr, k""")
def model_prediction(spark: SparkSession, d: str) -> DataFrame:
    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for name, target in (("n", S.Target.NOISE), ("x", S.Target.X_START), ("v", S.Target.V)):
            noise, start = diffusion.Diffusion(_half, steps=100, schedule=S.Schedule.LINEAR, target=target).predict(x, 40)
            out |= {f"noise_{name}": noise, f"start_{name}": start}
        return out

    names = ("noise_n", "start_n", "noise_x", "start_x", "noise_v", "start_v")
    return _by_batch(spark, d, f, ", ".join(f"{n} array<double>" for n in names)).select("profile_id", *[V.rounded(F.col(n)).alias(n) for n in names])


@q(f"""WITH {_AT} SELECT profile_id, {_EACH.format("b * sqrt(p) / (1 - a) * (x - sqrt(1 - a) * 0.5 * x) / sqrt(a) + (1 - p) * sqrt(1 - b) / (1 - a) * x")} AS mean, round(ln(b * (1 - p) / (1 - a)), 6) AS log_variance FROM pr, k""")
def reverse_step(spark: SparkSession, d: str) -> DataFrame:
    step = diffusion.Diffusion(_half, steps=100, schedule=S.Schedule.LINEAR)
    log_variance = step.mean_variance(np.zeros((1, 48)), 40)[1]
    return _by_batch(spark, d, lambda x: {"mean": step.mean_variance(x, 40)[0]}, "mean array<double>").select("profile_id", V.rounded(F.col("mean")).alias("mean"), r6(F.lit(log_variance)).alias("log_variance"))


@q(f"""WITH {PR}, {_LIN}, {_BAR}, f AS (SELECT exp(sum(ln(beta * sqrt(prev) / (1 - bar) * (1 - 0.5 * sqrt(1 - bar)) / sqrt(bar) + (1 - prev) * sqrt(1 - beta) / (1 - bar)))) AS f FROM c)
SELECT profile_id, {_EACH.format("x * f / 1000")} AS x FROM pr, f""")
def ancestral_fixed(spark: SparkSession, d: str) -> DataFrame:
    """All reverse steps without noise, in thousands."""
    walk = diffusion.Diffusion(_half, steps=100, schedule=S.Schedule.LINEAR)

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        for x in walk.ancestral(x, _NoNoise):  # noqa: B020
            pass
        return {"x": x / 1000}

    return _by_batch(spark, d, f, "x array<double>").select("profile_id", V.rounded(F.col("x")).alias("x"))


# ---------------------------------------------------------------- draws by counter
_WRAP = "18446744073709551616::UHUGEINT"


def _times(x: str, by: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {by}::UHUGEINT) % {_WRAP} AS UBIGINT)"


def _mixed_sql(x: str) -> str:
    """The 64-bit mixer of the draws on a column."""
    a = f"(SELECT {_times('xor(m.x, m.x >> 30)', int(randoms._A))} AS x FROM (SELECT {x} AS x) m)"
    b = f"(SELECT {_times('xor(m.x, m.x >> 27)', int(randoms._B))} AS x FROM {a} m)"
    return f"(SELECT xor(m.x, m.x >> 31) FROM {b} m)"


def _uniform_sql(ids: str, width: int, seed: int, stream: int) -> str:
    """(id, j, u) of uniforms() for the ids of a table."""
    base = int(randoms._mixed(np.array([seed * 1_000_003 + stream + 1], dtype=np.int64).view(np.uint64))[0])
    step = int(randoms._STEP)
    first = f"CAST((CAST({_times('id', step)} AS UHUGEINT) + {base}::UHUGEINT) % {_WRAP} AS UBIGINT)"
    each = f"CAST((CAST(key AS UHUGEINT) + CAST({_times('j', step)} AS UHUGEINT)) % {_WRAP} AS UBIGINT)"
    keys = f"SELECT id, {_mixed_sql('first')} AS key FROM (SELECT id, {first} AS first FROM {ids})"
    bits = f"SELECT id, j, {_mixed_sql('each')} AS bits FROM (SELECT id, j, {each} AS each FROM ({keys}), (SELECT unnest(range(1, {width + 1})) AS j))"
    return f"(SELECT id, CAST(j AS INTEGER) AS j, (CAST(bits >> 11 AS DOUBLE) + 0.5) / 9007199254740992 AS u FROM ({bits}))"


def _normal_sql(ids: str, width: int, seed: int) -> str:
    """(id, j, z) of normals(): the first half from the cosines, the second from the sines."""
    half = (width + 1) // 2
    pair = f"{_uniform_sql(ids, half, seed, 0)} a JOIN {_uniform_sql(ids, half, seed, 1)} b USING (id, j)"
    both = f"SELECT id, j, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS z FROM {pair} UNION ALL SELECT id, j + {half}, sqrt(-2 * ln(a.u)) * sin(2 * pi() * b.u) FROM {pair}"
    return f"(SELECT * FROM ({both}) WHERE j <= {width})"


@q(f"""WITH {PR}, p AS (SELECT profile_id AS id, row_number() OVER (ORDER BY md5(CAST(profile_id AS VARCHAR) || '|0'), profile_id) AS pos FROM pr), w AS (SELECT id FROM p WHERE pos <= 50)
SELECT n.id AS profile_id, 'gaussian' AS segment, list(round(20 * m.mean + z, 6) ORDER BY j) AS kwh FROM {_normal_sql("w", 48, 0)} n, mean_std m GROUP BY n.id""")
def gaussian_outliers(spark: SparkSession, d: str) -> DataFrame:
    mean = table(spark, d, "mean_std").first()["mean"]
    return noise.inject_noise(profiles(spark, d), "profile_id", "kwh", "gaussian", 50, mean).select("profile_id", "segment", V.rounded(F.col("kwh")).alias("kwh"))


@q(f"""WITH i AS (SELECT unnest(range(0, 5000)) AS id), c AS (SELECT id, CASE WHEN u <= 0.6 THEN 0 ELSE 1 END AS component FROM {_uniform_sql("i", 1, 0, 9)})
SELECT c.id, c.component, list(round(CASE component WHEN 0 THEN 0.2 + 0.2 * z ELSE 0.6 + 0.5 * z END, 6) ORDER BY j) AS v FROM c JOIN {_normal_sql("i", 3, 0)} n ON n.id = c.id GROUP BY 1, 2""")
def gmm_sample_fixed(spark: SparkSession, d: str) -> DataFrame:
    return mixture.sample(spark, _fixed_mixture(), 5000).select("id", "component", V.rounded(F.col("v")).alias("v"))
