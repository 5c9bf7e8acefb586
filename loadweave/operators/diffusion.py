"""Sampling from a trained denoiser: ancestral steps and fast exponential-integrator solvers, inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loadweave.functions.randoms import normals
from loadweave.functions.schedule import NoiseSchedule, Schedule, Target, Variance, betas, single_step_orders, time_steps

Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Diffusion:
    """A model with its schedule. Learned variances need a model that returns them, which none here does, so they raise."""

    model: Model
    steps: int = 1000
    schedule: Schedule = Schedule.COSINE
    target: Target = Target.NOISE
    variance: Variance = Variance.FIXED_SMALL
    clip: bool = False

    def __post_init__(self):
        if not isinstance(self.target, Target) or not isinstance(self.variance, Variance) or not isinstance(self.schedule, Schedule):
            raise ValueError("target, variance and schedule are enums")
        if self.variance is Variance.LEARNED_RANGE:
            raise NotImplementedError("learned variances")
        b = betas(self.schedule, self.steps)
        bar = np.cumprod(1 - b)
        object.__setattr__(self, "beta", b)
        object.__setattr__(self, "bar", bar)
        object.__setattr__(self, "prev", np.r_[1.0, bar[:-1]])

    def predict(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Noise and start at step t, whatever the model's target is; clipping touches the start only."""
        out = self.model(x, np.full(len(x), float(t)))
        a = self.bar[t]
        if self.target is Target.NOISE:
            start, noise = (x - np.sqrt(1 - a) * out) / np.sqrt(a), out
        elif self.target is Target.X_START:
            start, noise = out, (x - np.sqrt(a) * out) / np.sqrt(1 - a)
        else:
            start, noise = np.sqrt(a) * x - np.sqrt(1 - a) * out, np.sqrt(1 - a) * x + np.sqrt(a) * out
        return noise, np.clip(start, -1, 1) if self.clip else start

    def mean_variance(self, x: np.ndarray, t: int) -> tuple[np.ndarray, float]:
        """Mean and log variance of the reverse step."""
        _, start = self.predict(x, t)
        a, p, b = self.bar[t], self.prev[t], self.beta[t]
        mean = b * np.sqrt(p) / (1 - a) * start + (1 - p) * np.sqrt(1 - b) / (1 - a) * x
        small = self.beta * (1 - self.prev) / (1 - self.bar)
        fixed = small if self.variance is Variance.FIXED_SMALL else np.r_[small[1:2], self.beta[1:]]
        return mean, float(np.log(fixed[max(t, 1)] if self.variance is Variance.FIXED_SMALL and t == 0 else fixed[t]))

    def ancestral(self, x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
        """Every state from noise to sample."""
        for t in reversed(range(self.steps)):
            mean, log_var = self.mean_variance(x, t)
            x = mean + (np.exp(0.5 * log_var) * rng.normal(size=x.shape) if t else 0.0)
            yield x


def noise_of_score(score: Model, diffusion_bar: np.ndarray) -> Model:
    """A noise model from one that gives the score (slope of the log density): noise is the score times -sigma."""

    def model(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        sigma = np.sqrt(1 - diffusion_bar[np.clip(np.rint(t).astype(int), 0, len(diffusion_bar) - 1)])
        return -sigma.reshape(-1, *[1] * (x.ndim - 1)) * score(x, t)

    return model


def guided_by_condition(model: Callable[[np.ndarray, np.ndarray, object], np.ndarray], condition: object, scale: float = 1.0, none: object = None) -> Model:
    """A noise model led to a condition without classifier: from the unconditional noise `scale` times towards the conditional one."""

    def led(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        given = model(x, t, condition)
        if scale == 1.0 or none is None:
            return given
        free = model(x, t, none)
        return free + scale * (given - free)

    return led


def guided_by_classifier(model: Model, slope: Model, diffusion_bar: np.ndarray, scale: float = 1.0) -> Model:
    """A noise model led by a classifier: minus sigma times its slope of the log probability of the class, times `scale`."""
    lean = noise_of_score(slope, diffusion_bar)
    return lambda x, t: model(x, t) + scale * lean(x, t)


def dynamic_threshold(x0: np.ndarray, ratio: float = 0.995, most: float = 1.0) -> np.ndarray:
    """Scale rows whose quantile of |x| exceeds `most` back into range."""
    s = np.maximum(np.quantile(np.abs(x0.reshape(len(x0), -1)), ratio, axis=1), most).reshape(-1, *[1] * (x0.ndim - 1))
    return np.clip(x0, -s, s) / s


@dataclass(frozen=True)
class Solver:
    """Fast solver of the probability flow in half log signal-to-noise.

    Each step integrates exp-weighted polynomials through the model values (start or noise form) of up to `order`
    times; earlier steps' values (multistep) or values inside the step (singlestep) serve as nodes.
    """

    diffusion: Diffusion
    predict_start: bool = True
    threshold: bool = False
    form: str = "solver"

    def __post_init__(self):
        if self.form not in ("solver", "taylor"):
            raise ValueError(f"unknown form {self.form!r}; 'solver' or 'taylor'")

    @property
    def ns(self) -> NoiseSchedule:
        return NoiseSchedule(Schedule.DISCRETE, self.diffusion.bar)

    def value(self, x: np.ndarray, t: float) -> np.ndarray:
        d = self.diffusion
        step = (t - 1 / d.steps) * d.steps
        out = d.model(x, np.full(len(x), step))
        a, s = float(self.ns.alpha(t)), float(self.ns.sigma(t))
        if d.target is Target.NOISE:
            noise = out
        elif d.target is Target.X_START:
            noise = (x - a * out) / s
        else:
            noise = a * out + s * x
        if not self.predict_start:
            return noise
        start = (x - s * noise) / a
        return dynamic_threshold(start) if self.threshold else start

    def denoise(self, x: np.ndarray, t: float) -> np.ndarray:
        """The start seen from time t."""
        return self.value(x, t) if self.predict_start else (x - float(self.ns.sigma(t)) * self.value(x, t)) / float(self.ns.alpha(t))

    def step(self, x: np.ndarray, nodes: list[tuple[float, np.ndarray]], t: float) -> np.ndarray:
        """From the last node's time to t with a polynomial through all nodes, by divided differences (orders 1 to 3)."""
        ns = self.ns
        s, m0 = nodes[-1]
        ls, lt = float(ns.lam(s)), float(ns.lam(t))
        h = lt - ls
        if self.predict_start:
            keep, gain, e = float(ns.sigma(t) / ns.sigma(s)), float(ns.alpha(t)), -h
        else:
            keep, gain, e = float(ns.alpha(t) / ns.alpha(s)), -float(ns.sigma(t)), h
        phi1 = np.expm1(e)
        sign = -1.0 if self.predict_start else 1.0
        out = keep * x + gain * sign * phi1 * m0
        if len(nodes) == 1:
            return out
        l1 = float(ns.lam(nodes[-2][0]))
        r0 = (ls - l1) / h
        d1 = (m0 - nodes[-2][1]) / r0
        if len(nodes) == 2:
            return out + (gain * sign * 0.5 * phi1 if self.form == "solver" else self._slope_weight(gain, phi1, h)) * d1
        l2 = float(ns.lam(nodes[-3][0]))
        r1 = (l1 - l2) / h
        d11 = (nodes[-2][1] - nodes[-3][1]) / r1
        first = d1 + r0 / (r0 + r1) * (d1 - d11)
        second = (d1 - d11) / (r0 + r1)
        # integrals of exp-weighted u and u^2 / 2 over the step
        if self.predict_start:
            return out + gain * (phi1 / h + 1) * first - gain * ((phi1 + h) / h**2 - 0.5) * second
        return out + gain * (phi1 / h - 1) * first + gain * ((phi1 - h) / h**2 - 0.5) * second

    def inner(self, x: np.ndarray, s: float, t: float, order: int) -> np.ndarray:
        """A single step of the order, with nodes at the start and at equal parts of the step."""
        ns = self.ns
        nodes = [(s, self.value(x, s))]
        ls, lt = float(ns.lam(s)), float(ns.lam(t))
        for i in range(1, order):
            mid = float(ns.inverse_lam(ls + (lt - ls) * i / order))
            at = self._from_start(x, nodes, mid)
            nodes.append((mid, self.value(at, mid)))
        return self._from_start(x, nodes, t, last=True)

    def _slope_weight(self, gain: float, phi1: float, h: float) -> float:
        """Integral of the exp-weighted step against a slope of 1."""
        return gain * (phi1 / h + 1) if self.predict_start else gain * (phi1 / h - 1)

    def _from_start(self, x: np.ndarray, nodes: list, t: float, last: bool = False) -> np.ndarray:
        """Integrate from the first node to t by the slope between the first and the last node.

        Where the step ends, the solver form of order 2 takes half the first weight for that slope's, and the taylor
        form of order 3 the parabola through all nodes; else the slope is integrated.
        """
        ns = self.ns
        s, m0 = nodes[0]
        base = self.step(x, [nodes[0]], t)
        if len(nodes) == 1:
            return base
        h = float(ns.lam(t) - ns.lam(s))
        r = float(ns.lam(nodes[-1][0]) - ns.lam(s)) / h
        slope = (nodes[-1][1] - m0) / r
        gain, phi1 = (float(ns.alpha(t)), np.expm1(-h)) if self.predict_start else (-float(ns.sigma(t)), np.expm1(h))
        if last and len(nodes) == 2 and self.form == "solver":
            return base + (-0.5 if self.predict_start else 0.5) * gain * phi1 * slope
        if last and len(nodes) == 3 and self.form == "taylor":
            r1 = float(ns.lam(nodes[1][0]) - ns.lam(s)) / h
            near = (nodes[1][1] - m0) / r1
            first, second = (r * near - r1 * slope) / (r - r1), 2 * (slope - near) / (r - r1)
            w2 = self._slope_weight(gain, phi1, h)
            w3 = w2 / h - 0.5 * gain
            w3 = w2 / h - 0.5 * gain if self.predict_start else w2 / h - 0.5 * gain
            return base + w2 * first + (-w3 if self.predict_start else w3) * second
        return base + self._slope_weight(gain, phi1, h) * slope

    def sample(self, x: np.ndarray, steps: int = 20, order: int = 3, method: str = "multistep", grid: str = "time_uniform", end: float | None = None, atol: float = 0.0078, rtol: float = 0.05) -> np.ndarray:
        """From noise at time 1 to the sample; method: multistep, singlestep, singlestep_fixed or adaptive."""
        t0 = 1 / self.diffusion.steps if end is None else end
        if method == "adaptive":
            return self._adaptive(x, t0, atol, rtol)
        if method == "multistep":
            times = time_steps(self.ns, grid, 1.0, t0, steps)
            nodes: list[tuple[float, np.ndarray]] = []
            for i in range(steps):
                nodes = [*nodes, (times[i], self.value(x, times[i]))][-order:]
                # few steps end with low orders, which keeps the last one stable
                use = min(order, len(nodes), steps - i) if steps < 15 else min(order, len(nodes))
                x = self.step(x, nodes[-use:], times[i + 1])
            return x
        if method in ("singlestep", "singlestep_fixed"):
            orders = single_step_orders(steps, order) if method == "singlestep" else [order] * (steps // order)
            if grid == "logSNR" or method == "singlestep_fixed":
                times = time_steps(self.ns, grid, 1.0, t0, len(orders))
            else:
                times = time_steps(self.ns, grid, 1.0, t0, steps)[np.cumsum([0, *orders])]
            for i, o in enumerate(orders):
                x = self.inner(x, times[i], times[i + 1], o)
            return x
        raise ValueError(f"unknown method {method!r}")

    def _adaptive(self, x: np.ndarray, t0: float, atol: float, rtol: float) -> np.ndarray:
        """Orders 1 and 2 compared; the step length follows the error. Rows of a batch share their steps."""
        ns, s, h = self.ns, 1.0, 0.05
        before, end = x, float(ns.lam(t0))
        while end - float(ns.lam(s)) > 1e-5:
            h = min(h, end - float(ns.lam(s)))
            t = float(ns.inverse_lam(float(ns.lam(s)) + h))
            low, high = self.inner(x, s, t, 1), self.inner(x, s, t, 2)
            scale = np.maximum(atol, rtol * np.maximum(np.abs(low), np.abs(before)))
            err = float(np.sqrt((((high - low) / scale) ** 2).reshape(len(x), -1).mean(1)).max())
            if err <= 1:
                before, x, s = low, high, t
            h *= 0.9 * max(err, 1e-4) ** -0.5
        return x


def generate(spark: SparkSession, diffusion: Diffusion, n: int, length: int = 48, seed: int = 0, fast: bool = True, steps: int = 20, order: int = 3, method: str = "multistep", batch: int = 500) -> DataFrame:
    """id, v: n samples. The start noise of a sample depends on its id and the seed; batches run inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), batch):
                part = ids[i : i + batch]
                x = normals(part, length, seed)[:, :, None]
                if fast:
                    x = Solver(diffusion).sample(x, steps, order, method)
                else:
                    for x in diffusion.ancestral(x, np.random.default_rng([seed, int(part[0]), 1])):  # noqa: B020
                        pass
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(list(x[:, :, 0]), pa.list_(pa.float64()))], names=["id", "v"])

    return spark.range(n).mapInArrow(run, "id long, v array<double>")
