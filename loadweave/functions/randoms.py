"""Random numbers by counter: every draw is a hash of seed, row and place, so whole batches are drawn at once and a row's draws depend on nothing else."""

from __future__ import annotations

import numpy as np

#: fixed values: increment and multipliers of the public 64-bit mixer
_STEP, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def uniforms(ids: np.ndarray, width: int, seed: int = 0, stream: int = 0) -> np.ndarray:
    """(rows, width) numbers in (0, 1). Other streams of a row are independent."""
    with np.errstate(over="ignore"):
        key = _mixed(np.asarray(ids).astype(np.int64).view(np.uint64) * _STEP + _mixed(np.array([seed * 1_000_003 + stream + 1], dtype=np.int64).view(np.uint64)))
        bits = _mixed(key[:, None] + np.arange(1, width + 1, dtype=np.uint64)[None] * _STEP)
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def normals(ids: np.ndarray, width: int, seed: int = 0, stream: int = 0) -> np.ndarray:
    """(rows, width) standard normal numbers, two from each pair of uniforms."""
    half = (width + 1) // 2
    u, v = uniforms(ids, half, seed, 2 * stream), uniforms(ids, half, seed, 2 * stream + 1)
    r, a = np.sqrt(-2 * np.log(u)), 2 * np.pi * v
    return np.concatenate([r * np.cos(a), r * np.sin(a)], 1)[:, :width]


def gammas(ids: np.ndarray, width: int, shape: float, seed: int = 0) -> np.ndarray:
    """(rows, width) gamma numbers of scale 1: squeeze-and-reject on cubed normals, drawn again where rejected; a shape under 1 by its boost."""
    boost = uniforms(ids, width, seed, 1) ** (1 / shape) if shape < 1 else 1.0
    d = (shape + 1 if shape < 1 else shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, missing, attempt = np.zeros((len(ids), width)), np.ones((len(ids), width), bool), 1
    while missing.any():
        x, u = normals(ids, width, seed, 2 * attempt), uniforms(ids, width, seed, 4 * attempt + 2)
        v = (1 + c * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = missing & (v > 0) & (np.log(u) < 0.5 * x * x + d - d * v + d * np.log(np.where(v > 0, v, 1)))
        out[good] = d * v[good]
        missing &= ~good
        attempt += 1
    return out * boost
