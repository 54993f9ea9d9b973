"""Embeddings of a hierarchy in the Poincare ball or flat space.

A grid of configurations is trained in parallel, one group each; a configuration is numpy on one
machine: softmax cross-entropy of one positive against uniform negatives over negative distances, and
Riemannian gradient steps in the ball.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = 1e-5
OUT = "dim int, geometry string, node long, x array<double>"


def _distance(u: np.ndarray, v: np.ndarray, ball: bool):
    """Distances of u (b, 1, d) to v (b, m, d) and their gradients."""
    diff = u - v
    sq = (diff**2).sum(-1)
    if not ball:
        dist = np.sqrt(np.maximum(sq, 1e-12))
        g = diff / dist[..., None]
        return dist, g, -g
    a, b = 1 - np.minimum((u**2).sum(-1), 1 - EDGE), 1 - np.minimum((v**2).sum(-1), 1 - EDGE)
    arg = np.maximum(1 + 2 * sq / (a * b), 1 + 1e-7)
    k = 1 / np.sqrt(arg * arg - 1)
    gu = k[..., None] * (4 * diff / (a * b)[..., None] + 4 * (sq / (a * a * b))[..., None] * u)
    gv = k[..., None] * (-4 * diff / (a * b)[..., None] + 4 * (sq / (a * b * b))[..., None] * v)
    return np.arccosh(arg), gu, gv


def train(pairs: np.ndarray, n: int, dim: int, geometry: str, epochs: int = 60, negatives: int = 50, rate: float = 15.0, burn_in: int = 20, batch: int = 128, seed: int = 0) -> np.ndarray:
    """n points of dim numbers; pairs: (child, ancestor) rows.  One rate for both geometries, a tenth of it while burning in."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1e-3, 1e-3, (n, dim))
    ball = geometry == "poincare"
    for epoch in range(epochs if len(pairs) else 0):
        lr = rate * (0.1 if epoch < burn_in else 1.0)
        for rows in np.array_split(rng.permutation(len(pairs)), max(1, len(pairs) // batch)):
            child, other = pairs[rows, 0], np.concatenate([pairs[rows, 1:], rng.integers(0, n, (len(rows), negatives))], 1)
            d, gu, gv = _distance(e[child][:, None], e[other], ball)
            p = np.exp(-(d - d.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            w = -p
            w[:, 0] += 1  # gradient of the loss by each distance
            w /= len(rows)
            grad = np.zeros_like(e)
            np.add.at(grad, child, (w[..., None] * gu).sum(1))
            np.add.at(grad, other, w[..., None] * gv)
            if ball:
                grad *= ((1 - (e**2).sum(1)) ** 2 / 4)[:, None]
            e -= lr * grad
            if ball:
                size = np.linalg.norm(e, axis=1, keepdims=True)
                e *= np.minimum(1, (1 - EDGE - 1e-6) / np.maximum(size, 1e-12))
    return e


def grid(pairs: DataFrame, dims: list[int], geometries: list[str], epochs: int = 60, seed: int = 0, rate: float = 15.0, burn_in: int = 20) -> DataFrame:
    """dim, geometry, node, x; pairs: child, ancestor (a hierarchy that one machine can hold)."""
    cfg = pairs.sparkSession.createDataFrame([(d, g) for d in dims for g in geometries], "dim int, geometry string")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(pdf[["child", "ancestor"]].to_numpy())
        e = train(np.searchsorted(nodes, pdf[["child", "ancestor"]].sort_values(["child", "ancestor"]).to_numpy()), len(nodes), int(key[0]), key[1], epochs=epochs, seed=seed, rate=rate, burn_in=burn_in)
        return pd.DataFrame({"dim": int(key[0]), "geometry": key[1], "node": nodes, "x": list(e.tolist())})

    return pairs.select("child", "ancestor").crossJoin(F.broadcast(cfg)).groupBy("dim", "geometry").applyInPandas(run, OUT)
