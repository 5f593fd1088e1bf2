"""Inference of small generator networks: rows of latent noise through broadcast weights, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _dense(x: np.ndarray, layers: list, slope: float) -> np.ndarray:
    """Leaky layers, and a linear last one. A layer is (weights of shape (out, in), bias)."""
    for i, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if i < len(layers) - 1:
            x = np.where(x >= 0, x, slope * x)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def unit_rows(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)


@dataclass
class Mlp:
    """A plain network."""

    layers: list
    slope: float = 0.2

    def __call__(self, z: np.ndarray, noise: np.ndarray) -> np.ndarray:
        return _dense(z, self.layers, self.slope)


@dataclass
class Gated:
    """A trunk, a head of sizes (softplus) and a head of gates: an output is its size where the noisy gate is open, else exactly 0. Rows are of
    unit norm and never zero: where all gates are closed the most likely one opens, and sizes have a floor."""

    trunk: list
    sizes: tuple
    gates: tuple
    slope: float = 0.2
    temperature: float = 1.0
    clamp: float = 10.0
    eps: float = 1e-8

    def gate(self, logits: np.ndarray, noise: np.ndarray) -> np.ndarray:
        bounded = self.clamp * np.tanh(logits / self.clamp)
        u = np.clip(noise, self.eps, 1 - self.eps)
        opened = _sigmoid((bounded + np.log(u) - np.log1p(-u)) / self.temperature) > 0.5
        shut = np.flatnonzero(~opened.any(1))
        opened[shut, bounded[shut].argmax(1)] = True
        return opened

    def __call__(self, z: np.ndarray, noise: np.ndarray) -> np.ndarray:
        h = _dense(z, self.trunk, self.slope)
        h = np.where(h >= 0, h, self.slope * h)
        size = np.maximum(np.logaddexp(0, h @ self.sizes[0].T + self.sizes[1]), 100 * self.eps)
        return unit_rows(size * self.gate(h @ self.gates[0].T + self.gates[1], noise), self.eps)


@dataclass
class StructuredGated(Gated):
    """Gates of a 4 x 4 x 8 layout, smoothed over neighbouring cells (edges repeated) and orientations (in a circle) by a 3 x 3 x 3 kernel."""

    kernel: np.ndarray | None = None

    def gate(self, logits: np.ndarray, noise: np.ndarray) -> np.ndarray:
        g = logits.reshape(-1, 4, 4, 8)
        if self.kernel is not None:
            p = np.pad(g, ((0, 0), (1, 1), (1, 1), (0, 0)), mode="edge")
            p = np.concatenate([p[..., -1:], p, p[..., :1]], -1)
            g = sum(self.kernel[a, b, c] * p[:, a : a + 4, b : b + 4, c : c + 8] for a in range(3) for b in range(3) for c in range(3))
        return super().gate(g.reshape(len(logits), -1), noise)


KINDS: dict[str, Callable] = {"mlp": Mlp, "gated": Gated, "sparse": Gated, "structured_gate": StructuredGated}


def build(kind: str, **weights):
    if kind not in KINDS:
        raise ValueError(f"the generator {kind!r} is unknown; there are {', '.join(KINDS)}")
    return KINDS[kind](**weights)


def random_layers(sizes: list[int], seed: int) -> list:
    rng = np.random.default_rng(seed)
    return [(rng.standard_normal((b, a)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def generate(spark: SparkSession, network, rows: int, latent: int, width: int, seed: int = 42) -> DataFrame:
    """vec_id, v, of unit norm: each row's noise comes from its own id, so partitions and retries change nothing."""
    sent = spark.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            rngs = [np.random.default_rng([seed, i]) for i in batch.column(0).to_pylist()]
            z = np.array([r.standard_normal(latent) for r in rngs]).reshape(-1, latent)
            noise = np.array([r.uniform(1e-12, 1 - 1e-12, width) for r in rngs]).reshape(-1, width)
            v = unit_rows(sent.value(z, noise)).astype(np.float32) if len(rngs) else np.zeros((0, width), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float32()))], ["vec_id", "v"])

    return spark.range(rows).mapInArrow(run, "vec_id long, v array<float>")
