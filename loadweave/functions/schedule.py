"""Diffusion schedules: T-row tables in Spark and the same quantities in NumPy for the samplers."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Target(enum.Enum):
    NOISE = "noise"
    X_START = "x_start"
    V = "v"


class Variance(enum.Enum):
    FIXED_SMALL = "fixed_small"
    FIXED_LARGE = "fixed_large"
    LEARNED_RANGE = "learned_range"


class Schedule(enum.Enum):
    LINEAR = "linear"
    COSINE = "cosine"
    DISCRETE = "discrete"


def beta_table(spark: SparkSession, kind: Schedule | str, steps: int, s: float = 0.008) -> DataFrame:
    """(t, beta). Linear: steps points from 1e-4 to 2e-2, scaled by 1000 / steps; cosine: clipped to [0, .999]. Others raise."""
    kind = Schedule(kind)
    t = spark.range(steps).select(F.col("id").cast("int").alias("t"))
    if kind is Schedule.LINEAR:
        lo, hi = 1000 / steps * 1e-4, 1000 / steps * 2e-2
        return t.withColumn("beta", F.lit(lo) + F.col("t") * F.lit((hi - lo) / max(1, steps - 1)))
    if kind is Schedule.COSINE:
        def g(i):
            return F.pow(F.cos((i / F.lit(float(steps)) + s) / F.lit(1 + s) * F.lit(math.pi / 2)), 2)

        return t.withColumn("beta", F.least(F.greatest(1 - g(F.col("t") + 1) / g(F.col("t")), F.lit(0.0)), F.lit(0.999)))
    raise ValueError(f"no table for schedule {kind.value}")


def coefficient_table(betas: DataFrame) -> DataFrame:
    """alpha_bar, its lag, and everything derived from them. A table of T rows by parameter, so one window task is enough."""
    w = Window.orderBy("t")
    df = betas.withColumn("alpha_bar", F.exp(F.sum(F.log(1 - F.col("beta"))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumn("alpha_bar_prev", F.lag("alpha_bar", 1, 1.0).over(w))
    a, p, b = F.col("alpha_bar"), F.col("alpha_bar_prev"), F.col("beta")
    df = df.withColumns(
        {
            "sqrt_alpha_bar": F.sqrt(a),
            "sqrt_one_minus": F.sqrt(1 - a),
            "log_one_minus": F.log(1 - a),
            "recip_sqrt": F.sqrt(1 / a),
            "recip_minus_one_sqrt": F.sqrt(1 / a - 1),
            "posterior_variance": b * (1 - p) / (1 - a),
            "posterior_mean_x0": b * F.sqrt(p) / (1 - a),
            "posterior_mean_xt": (1 - p) * F.sqrt(1 - b) / (1 - a),
            "snr": a / (1 - a),
        }
    )
    second = F.lead("posterior_variance").over(w)
    return df.withColumn("posterior_log_variance", F.log(F.when(F.col("t") == 0, second).otherwise(F.col("posterior_variance"))))


def loss_weights(coefficients: DataFrame) -> DataFrame:
    """(t, noise, x_start, v): weights by target: 1, snr, snr / (snr + 1)."""
    return coefficients.select("t", F.lit(1.0).alias("noise"), F.col("snr").alias("x_start"), (F.col("snr") / (F.col("snr") + 1)).alias("v"))


def _zip(a, b, f):
    return F.zip_with(a, b, f)


def q_sample(x0, noise, c):
    """x_t = sqrt(alpha_bar) x_0 + sqrt(1 - alpha_bar) noise; c is the joined schedule row."""
    return _zip(x0, noise, lambda x, e: c["sqrt_alpha_bar"] * x + c["sqrt_one_minus"] * e)


def q_posterior_mean(x0, xt, c):
    return _zip(x0, xt, lambda x, y: c["posterior_mean_x0"] * x + c["posterior_mean_xt"] * y)


def start_from_noise(xt, noise, c):
    return _zip(xt, noise, lambda x, e: c["recip_sqrt"] * x - c["recip_minus_one_sqrt"] * e)


def noise_from_start(xt, x0, c):
    return _zip(xt, x0, lambda x, s: (c["recip_sqrt"] * x - s) / c["recip_minus_one_sqrt"])


def v_from_noise(x0, noise, c):
    return _zip(x0, noise, lambda x, e: c["sqrt_alpha_bar"] * e - c["sqrt_one_minus"] * x)


def start_from_v(xt, v, c):
    return _zip(xt, v, lambda x, y: c["sqrt_alpha_bar"] * x - c["sqrt_one_minus"] * y)


# ------------------------------------------------------------ NumPy side
def betas(kind: Schedule | str, steps: int, s: float = 0.008) -> np.ndarray:
    kind = Schedule(kind)
    if kind is Schedule.LINEAR:
        return np.linspace(1000 / steps * 1e-4, 1000 / steps * 2e-2, steps)
    if kind is Schedule.COSINE:
        g = np.cos((np.arange(steps + 1) / steps + s) / (1 + s) * np.pi / 2) ** 2
        return np.clip(1 - g[1:] / g[:-1], 0, 0.999)
    raise ValueError(f"no betas for schedule {kind.value}")


def interpolate(x: np.ndarray, xp: np.ndarray, yp: np.ndarray) -> np.ndarray:
    """Piecewise linear through (xp, yp), xp ascending; straight on beyond both ends."""
    i = np.clip(np.searchsorted(xp, x) - 1, 0, len(xp) - 2)
    return yp[i] + (x - xp[i]) * (yp[i + 1] - yp[i]) / (xp[i + 1] - xp[i])


@dataclass(frozen=True)
class NoiseSchedule:
    """Continuous time in [0, 1]: log alpha, alpha, sigma, half log signal-to-noise and its inverse."""

    kind: Schedule
    alphas_bar: np.ndarray | None = None
    beta_0: float = 0.1
    beta_1: float = 20.0
    s: float = 0.008

    def _grid(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.alphas_bar)
        return np.arange(1, n + 1) / n, 0.5 * np.log(self.alphas_bar)

    def log_alpha(self, t):
        t = np.asarray(t, dtype=float)
        if self.kind is Schedule.DISCRETE:
            return interpolate(t, *self._grid())
        if self.kind is Schedule.LINEAR:
            return -(t**2) * (self.beta_1 - self.beta_0) / 4 - t * self.beta_0 / 2
        cos = lambda u: np.log(np.cos((u + self.s) / (1 + self.s) * np.pi / 2))
        return cos(t) - cos(0.0)

    def alpha(self, t):
        return np.exp(self.log_alpha(t))

    def sigma(self, t):
        return np.sqrt(-np.expm1(2 * self.log_alpha(t)))

    def lam(self, t):
        return self.log_alpha(t) - np.log(self.sigma(t))

    def inverse_lam(self, lam):
        lam = np.asarray(lam, dtype=float)
        la = -0.5 * np.logaddexp(0.0, -2 * lam)
        if self.kind is Schedule.DISCRETE:
            t, log_alpha = self._grid()
            return interpolate(la, log_alpha[::-1], t[::-1])
        if self.kind is Schedule.LINEAR:
            # the root of the quadratic in t that log alpha is
            d = self.beta_1 - self.beta_0
            return (-self.beta_0 + np.sqrt(self.beta_0**2 - 4 * d * la)) / d
        first = np.log(np.cos(self.s / (1 + self.s) * np.pi / 2))
        return np.arccos(np.exp(la + first)) * 2 * (1 + self.s) / np.pi - self.s


def time_steps(ns: NoiseSchedule, kind: str, start: float, end: float, n: int) -> np.ndarray:
    """n + 1 times from start down to end: even in log signal-to-noise, in time or in its square root."""
    if kind == "logSNR":
        return ns.inverse_lam(np.linspace(ns.lam(start), ns.lam(end), n + 1))
    if kind == "time_uniform":
        return np.linspace(start, end, n + 1)
    if kind == "time_quadratic":
        return np.linspace(np.sqrt(start), np.sqrt(end), n + 1) ** 2
    raise ValueError(f"no step grid {kind!r}")


def single_step_orders(steps: int, order: int) -> list[int]:
    """Orders of the single-step solver that use exactly `steps` evaluations."""
    if order not in (1, 2, 3):
        raise ValueError("the order must be 1, 2 or 3")
    whole, rest = divmod(steps, order)
    if order == 3 and rest == 0:
        return [3] * (whole - 1) + [2, 1]
    return [order] * whole + ([rest] if rest else [])
