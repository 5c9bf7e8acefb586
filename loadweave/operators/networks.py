"""Small networks in NumPy on Arrow batches: the conditional autoencoder, its private training, the denoiser.

Training is data-parallel: rows are dealt to mini-batches by hash, batches to workers; each epoch parameters and Adam's
moments travel to the workers, each takes a step per batch, and their means by rows come back. With privacy each row's
gradient is clipped before it is summed and a draw of noise is added per batch.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions.randoms import normals
from loadweave.operators.losses import KERNEL_WIDTHS
from loadweave.operators.ordering import hash_order
from loadweave.session import stage_table

_C = math.sqrt(2 / math.pi)


def erf(x: np.ndarray) -> np.ndarray:
    """Error function to 1.5e-7 (a rational approximation)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * y


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2))) + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def mmd_and_slope(out: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Maximum mean discrepancy of two batches of equal size (mean over all pairs, four Gaussian kernels) and its slope in out."""

    def kernels(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
        each = [np.exp(-0.5 * d / w) for w in KERNEL_WIDTHS]
        return sum(k.mean() for k in each), sum(k / w for k, w in zip(each, KERNEL_WIDTHS, strict=True))

    (oo, go), (xx, _), (ox, gx) = kernels(out, out), kernels(x, x), kernels(out, x)
    slope = gx.sum(1)[:, None] * out - gx @ x - go.sum(1)[:, None] * out + go @ out
    return float(oo + xx - 2 * ox), 2 * slope / len(x) ** 2


@dataclass(frozen=True)
class AutoencoderConfig:
    """Shapes and loss weights; hidden may be any list of widths, and the decoder has its mirror unless it has widths of its own."""

    input_dim: int = 48
    class_dim: int = 2
    latent_dim: int = 16
    hidden: tuple[int, ...] = (512, 256, 128, 64, 32)
    decoder_hidden: tuple[int, ...] | None = None
    mse: float = 2.0
    quantiles: tuple[tuple[float, float], ...] = ((0.95, 4.0), (0.05, 1.0), (0.5, 4.0))


@dataclass
class Autoencoder:
    """Parameters as a flat dict of arrays: e0.w, e0.b, ..., mu.w, sigma.w, d0.w, ..."""

    config: AutoencoderConfig
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(config: AutoencoderConfig, seed: int = 0) -> Autoencoder:
        rng = np.random.default_rng(seed)
        c = config
        p: dict[str, np.ndarray] = {}

        def linear(name: str, a: int, b: int) -> None:
            r = 1 / math.sqrt(a)
            p[f"{name}.w"], p[f"{name}.b"] = rng.uniform(-r, r, (a, b)), rng.uniform(-r, r, b)

        enc = [c.input_dim + c.class_dim, *c.hidden, c.latent_dim]
        dec = [c.latent_dim + c.class_dim, c.latent_dim, *(reversed(c.hidden) if c.decoder_hidden is None else c.decoder_hidden), c.input_dim]
        for i in range(len(enc) - 1):
            linear(f"e{i}", enc[i], enc[i + 1])
        for i in range(len(dec) - 1):
            linear(f"d{i}", dec[i], dec[i + 1])
        linear("mu", c.latent_dim, c.latent_dim)
        linear("sigma", c.latent_dim, c.latent_dim)
        return Autoencoder(c, p)

    def _chain(self, prefix: str) -> list[str]:
        return [f"{prefix}{i}" for i in range(sum(k.startswith(prefix) and k.endswith(".w") and k[1:-2].isdigit() for k in self.p))]

    def _forward(self, prefix: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        names, tape = self._chain(prefix), []
        for i, n in enumerate(names):
            z = x @ self.p[f"{n}.w"] + self.p[f"{n}.b"]
            tape.append((n, x, z, i < len(names) - 1))
            x = gelu(z) if i < len(names) - 1 else z
        return x, tape

    def encode(self, x: np.ndarray, f: np.ndarray, eps: np.ndarray) -> np.ndarray:
        """mu + eps * sigma: the second head is the scale itself."""
        h, _ = self._forward("e", np.concatenate([x, f], 1))
        return h @ self.p["mu.w"] + self.p["mu.b"] + eps * (h @ self.p["sigma.w"] + self.p["sigma.b"])

    def decode(self, z: np.ndarray, f: np.ndarray) -> np.ndarray:
        return self._forward("d", np.concatenate([z, f], 1))[0]

    def loss_and_slope(self, out: np.ndarray, x: np.ndarray, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Per-row loss (discrepancy of the batch, or of each row alone, squared error and pinball terms) and the slope of its sum in the output."""
        d = x.shape[1]
        diff = out - x
        if alone:
            each = [np.exp(-0.5 * (diff**2).sum(1) / w) for w in KERNEL_WIDTHS]
            mmd = 2 * len(KERNEL_WIDTHS) - 2 * sum(each)
            slope = 2 * sum(k / w for k, w in zip(each, KERNEL_WIDTHS, strict=True))[:, None] * diff / len(x)  # the sum over rows is scaled below
        else:
            mmd, slope = mmd_and_slope(out, x)
        loss, slope = mmd + self.config.mse * (diff**2).mean(1), len(x) * slope + self.config.mse * 2 * diff / d
        for q, w in self.config.quantiles:
            loss = loss + w * np.maximum(-q * diff, (1 - q) * diff).mean(1)
            slope = slope + w * np.where(diff < 0, -q, 1 - q) / d
        return loss, slope

    def gradients(self, x: np.ndarray, f: np.ndarray, eps: np.ndarray, clip: float | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Summed loss and gradients; with clip each row's whole gradient is scaled to at most that norm first.

        A row's gradient of a layer is its input times its slope, so its norm is the product of theirs and no row's
        gradient is ever formed; the scaled inputs then give the sum in one product.
        """
        h, enc = self._forward("e", np.concatenate([x, f], 1))
        sigma = h @ self.p["sigma.w"] + self.p["sigma.b"]
        z = h @ self.p["mu.w"] + self.p["mu.b"] + eps * sigma
        out, dec = self._forward("d", np.concatenate([z, f], 1))
        loss, slope = self.loss_and_slope(out, x, alone=clip is not None)
        layers: list[tuple[str, np.ndarray, np.ndarray]] = []

        def back(tape: list, slope: np.ndarray) -> np.ndarray:
            for n, xin, zz, active in reversed(tape):
                if active:
                    slope = slope * gelu_slope(zz)
                layers.append((n, xin, slope))
                slope = slope @ self.p[f"{n}.w"].T
            return slope

        dz = back(dec, slope)[:, : z.shape[1]]
        ds = dz * eps
        layers += [("mu", h, dz), ("sigma", h, ds)]
        back(enc, dz @ self.p["mu.w"].T + ds @ self.p["sigma.w"].T)
        if clip is not None:
            norm = np.sqrt(sum(((xin * xin).sum(1) + 1) * (s * s).sum(1) for _, xin, s in layers))
            scale = np.minimum(1.0, clip / (norm + 1e-12))[:, None]
            layers = [(n, xin, s * scale) for n, xin, s in layers]
        g = {}
        for n, xin, s in layers:
            g[f"{n}.w"], g[f"{n}.b"] = xin.T @ s, s.sum(0)
        return float(loss.sum()), g


@dataclass
class Adam:
    rate: float = 1e-3
    b1: float = 0.9
    b2: float = 0.999
    step_no: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, p: dict, g: dict, rate: float | None = None) -> None:
        self.step_no += 1
        for k, x in g.items():
            self.m[k] = self.b1 * self.m.get(k, 0) + (1 - self.b1) * x
            self.v[k] = self.b2 * self.v.get(k, 0) + (1 - self.b2) * x * x
            p[k] = p[k] - (rate or self.rate) * (self.m[k] / (1 - self.b1**self.step_no)) / (np.sqrt(self.v[k] / (1 - self.b2**self.step_no)) + 1e-8)


def cosine_rate(rate: float, epoch: int, tmax: int) -> float:
    """From rate down to a fifth of it over tmax epochs."""
    low = rate / 5
    return low + (rate - low) * (1 + math.cos(math.pi * min(epoch, tmax) / tmax)) / 2


def epsilon_spent(noise: float, share: float, steps: int, delta: float) -> float:
    """Privacy spent by the subsampled Gaussian mechanism, by Renyi orders 2..63 (integer-order bound of the literature)."""
    best = float("inf")
    for a in range(2, 64):
        terms = [math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1) + k * math.log(share) + (a - k) * math.log1p(-share if share < 1 else -1 + 1e-12) + k * (k - 1) / (2 * noise**2) for k in range(a + 1)]
        top = max(terms)
        rdp = (top + math.log(sum(math.exp(t - top) for t in terms))) / (a - 1)
        best = min(best, steps * rdp + math.log(1 / delta) / (a - 1))
    return best


def noise_for(epsilon: float, delta: float, share: float, steps: int) -> float:
    """Least noise multiplier (to 1 %) that keeps epsilon."""
    lo, hi = 0.2, 1.0
    while epsilon_spent(hi, share, steps, delta) > epsilon:
        hi *= 2
    while hi / lo > 1.01:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if epsilon_spent(mid, share, steps, delta) > epsilon else (lo, mid)
    return hi


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = b.column(0).to_numpy(zero_copy_only=False)
    return ids, b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _inputs(df: DataFrame, key: str, vector: str, features: list[str]) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.array(*[F.col(f).cast("double") for f in features]).alias("f"))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, ids, vectors, features) of rows that come sorted by bucket, the last column."""
    now, held = -1, []
    for b in batches:
        if b.num_rows:
            cols, of = _columns(b), b.column(3).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and of[lo] != now:
                    yield now, *(np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                now = int(of[lo])
                held.append(tuple(c[lo:hi] for c in cols))
    if held:
        yield now, *(np.concatenate(c) for c in zip(*held, strict=True))


def train(df: DataFrame, key: str, vector: str, features: list[str], config: AutoencoderConfig, epochs: int = 5, rate: float = 1e-3, seed: int = 0, private: tuple[float, float, float] | None = None, batch_rows: int = 200, worker_batches: int = 64, most_workers: int = 256) -> tuple[Autoencoder, list[float]]:
    """Mini-batch training: the model and the mean loss of each epoch, taken while it trains.

    Every epoch deals all rows anew to batches of about batch_rows. A worker steps through about worker_batches of them
    (more only beyond most_workers); fewer would be averaged away. The result doesn't depend on the partitioning.
    private: (epsilon, delta, clip norm in (0, 1]). A row is in one batch per epoch, and batches of other rows cost it
    nothing, so the noise follows from epsilon, delta and the epochs. Its discrepancy term is that of the row alone, as
    one over the batch would carry other rows past the clip.
    """
    net, losses = Autoencoder.fresh(config, seed), []
    data = _inputs(df, key, vector, features)
    clip = noise = None
    if private is not None:
        epsilon, delta, clip = private
        if not 0 < clip <= 1:
            raise ValueError("the clip norm must lie in (0, 1]")
        noise = noise_for(epsilon, delta, 1.0, epochs)
    n = data.count()
    if not n:
        raise ValueError("no data")
    batches = max(1, round(n / batch_rows))
    workers = min(most_workers, max(1, round(batches / worker_batches)))
    names = list(net.p)
    adam = Adam(rate, m={k: np.zeros_like(net.p[k]) for k in names}, v={k: np.zeros_like(net.p[k]) for k in names})
    for epoch in range(epochs):
        step_rate = rate if private else cosine_rate(rate, epoch, epochs)
        start = (net.p, adam.m, adam.v, adam.step_no)

        def run(rows: Iterator[pa.RecordBatch], start=start, epoch=epoch, step_rate=step_rate) -> Iterator[pa.RecordBatch]:
            p, m, v, steps = start
            own, opt = Autoencoder(config, dict(p)), Adam(rate, m=dict(m), v=dict(v), step_no=steps)
            total, seen = 0.0, 0
            for bucket, ids, x, f in _buckets(rows):
                loss, g = own.gradients(x, f, normals(ids, config.latent_dim, seed * 1009 + epoch), clip)
                size = len(ids)
                if noise is not None:
                    rng = np.random.default_rng([seed + 1, epoch, bucket])
                    # a size that doesn't depend on single rows
                    g, size = {k: g[k] + rng.normal(0, noise * clip, g[k].shape) for k in names}, n / batches
                opt.step(own.p, {k: g[k] / size for k in names}, step_rate)
                total, seen = total + loss, seen + len(ids)
            if seen:
                flat = b"".join(np.ascontiguousarray(part[k]).tobytes() for part in (own.p, opt.m, opt.v) for k in names)
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([seen]), pa.array([opt.step_no]), pa.array([flat], pa.binary())], names=["loss", "n", "steps", "state"])

        bucket = F.pmod(F.conv(F.substring(hash_order(F.col("id"), seed * 1009 + epoch), 1, 12), 16, 10).cast("long"), F.lit(batches)).cast("int")
        dealt = data.withColumn("b", bucket).repartitionById(workers, (F.col("b") % workers).cast("int")).sortWithinPartitions("b", "id")
        # written, so that the workers run side by side and the driver holds one state at a time
        parts = stage_table(dealt.mapInArrow(run, "loss double, n long, steps long, state binary"), "epoch")
        total, steps, state = 0.0, 0.0, 0.0
        for r in parts.orderBy("loss", "n").toLocalIterator():
            share = r["n"] / n
            total, steps, state = total + r["loss"], steps + share * r["steps"], state + share * np.frombuffer(bytes(r["state"]))
        at = 0
        for part in (net.p, adam.m, adam.v):
            for k in names:
                shape, size = part[k].shape, part[k].size
                part[k] = state[at : at + size].reshape(shape)
                at += size
        adam.step_no = round(steps)
        losses.append(total / n)
    return net, losses


def save_network(net: Autoencoder | Denoiser, spark: SparkSession, path: str) -> None:
    """Write a network as a table: its shape as JSON in the row without values, then one row per parameter."""
    shape = asdict(net.config) if isinstance(net, Autoencoder) else {k: v for k, v in asdict(net).items() if k != "p"}
    rows = [(json.dumps({"kind": type(net).__name__, **shape}), None, None)] + [(k, list(v.shape), v.ravel().tolist()) for k, v in net.p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, x array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Autoencoder | Denoiser:
    """Read what save_network wrote. The driver gets the parameters, which it needs to run the network."""
    rows = spark.read.parquet(path).collect()
    shape = json.loads(next(r["name"] for r in rows if r["shape"] is None))
    p = {r["name"]: np.array(r["x"]).reshape(r["shape"]) for r in rows if r["shape"] is not None}
    if shape.pop("kind") == "Denoiser":
        return Denoiser(**shape, p=p)
    shape["decoder_hidden"] = None if shape["decoder_hidden"] is None else tuple(shape["decoder_hidden"])
    shape |= {"hidden": tuple(shape["hidden"]), "quantiles": tuple(map(tuple, shape["quantiles"]))}
    return Autoencoder(AutoencoderConfig(**shape), p)


def encode(df: DataFrame, key: str, vector: str, features: list[str], net: Autoencoder, seed: int = 0, weight: str | None = None) -> DataFrame:
    """id, z (latent values followed by the features), and the weight column if one is named; a missing one raises."""
    if weight is not None:
        if weight not in df.columns:
            raise KeyError(weight)
        kept = df.select(F.col(key).cast("long").alias("id"), F.col(weight))
        return encode(df, key, vector, features, net, seed).join(kept, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x, f = _columns(b)
                z = net.encode(x, f, normals(ids, net.config.latent_dim, seed))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.concatenate([z, f], 1)), pa.list_(pa.float64()))], names=["id", "z"])

    return _inputs(df, key, vector, features).mapInArrow(run, "id long, z array<double>")


def decode(df: DataFrame, key: str, latent: str, features: list[str], net: Autoencoder) -> DataFrame:
    """id, f, v: decoded profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, z, f = _columns(b)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(net.decode(z, f)), pa.list_(pa.float64()))], names=["id", "f", "v"])

    return _inputs(df, key, latent, features).mapInArrow(run, "id long, f array<double>, v array<double>")


# ------------------------------------------------------------ denoising transformer
def rms_norm(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12) * g * math.sqrt(x.shape[-1])


def layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-6)


def position_embedding(p: np.ndarray, dim: int) -> np.ndarray:
    half = dim // 2
    a = np.asarray(p, float)[:, None] * np.exp(-np.arange(half) * math.log(10000) / (half - 1))[None]
    return np.concatenate([np.sin(a), np.cos(a)], 1)


@dataclass
class Denoiser:
    """Time-conditioned transformer on (batch, length, channel); forward only."""

    width: int
    channels: int = 1
    heads: int = 4
    layers: int = 2
    feed: int = 64
    convolve: bool = True
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 0, **shape) -> Denoiser:
        net = Denoiser(**shape)
        if net.width % net.heads or net.width % 2:
            raise ValueError("the width must be even and divisible by the heads")
        rng = np.random.default_rng(seed)
        w = net.width

        def linear(name: str, a: int, b: int, zero: bool = False) -> None:
            r = 0.0 if zero else math.sqrt(6 / (a + b))
            net.p[f"{name}.w"], net.p[f"{name}.b"] = rng.uniform(-r, r, (a, b)) if r else np.zeros((a, b)), np.zeros(b)

        linear("time0", w, w)
        linear("time1", w, 3 * w)
        linear("pos0", w, w)
        linear("pos1", w, w)
        linear("init", net.channels * (5 if net.convolve else 1), w)
        for i in range(net.layers):
            linear(f"l{i}.qkv", w, 3 * w)
            linear(f"l{i}.out", w, w)
            linear(f"l{i}.up", w, net.feed)
            linear(f"l{i}.down", net.feed, w)
            linear(f"l{i}.mod", w, 6 * w, zero=True)
            for n in ("q", "k", "o"):
                net.p[f"l{i}.g{n}"] = np.ones(w)
        linear("mod", w, 2 * w, zero=True)
        linear("final", 2 * w, net.channels)
        return net

    def _lin(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.p[f"{name}.w"] + self.p[f"{name}.b"]

    def _attention(self, i: int, x: np.ndarray) -> np.ndarray:
        b, n, w = x.shape
        q, k, v = np.split(self._lin(f"l{i}.qkv", x), 3, axis=2)
        q, k = rms_norm(q, self.p[f"l{i}.gq"]), rms_norm(k, self.p[f"l{i}.gk"])
        split = lambda t: t.reshape(b, n, self.heads, w // self.heads).transpose(0, 2, 1, 3)
        s = split(q) * (w // self.heads) ** -0.5 @ split(k).transpose(0, 1, 3, 2)
        s = np.exp(s - s.max(-1, keepdims=True))
        o = (s / s.sum(-1, keepdims=True)) @ split(v)
        return rms_norm(self._lin(f"l{i}.out", o.transpose(0, 2, 1, 3).reshape(b, n, w)), self.p[f"l{i}.go"])

    def __call__(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        scale, shift, cond = np.split(self._lin("time1", gelu(self._lin("time0", position_embedding(t, self.width))))[:, None], 3, axis=2)
        if self.convolve:
            pad = np.pad(x, ((0, 0), (2, 2), (0, 0)))
            h = self._lin("init", np.concatenate([pad[:, i : i + x.shape[1]] for i in range(5)], 2))
        else:
            h = self._lin("init", x)
        skip = h
        h = silu(h * (1 + scale) + shift) + self._lin("pos1", gelu(self._lin("pos0", position_embedding(np.arange(x.shape[1]), self.width))))[None]
        for i in range(self.layers):
            sa, ba, ga, sm, bm, gm = np.split(self._lin(f"l{i}.mod", silu(cond)), 6, axis=2)
            h = h + ga * self._attention(i, layer_norm(h) * (1 + sa) + ba)
            h = h + gm * self._lin(f"l{i}.down", silu(self._lin(f"l{i}.up", layer_norm(h) * (1 + sm) + bm)))
        s, b = np.split(self._lin("mod", silu(cond)), 2, axis=2)
        return self._lin("final", np.concatenate([layer_norm(h) * (1 + s) + b, skip], 2))
