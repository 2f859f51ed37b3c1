"""Simulated data with known truth: smooth bases, Gaussian weights, levels, noise and a mask.

Truth is drawn on the driver (it is as small as the model); responses are made by a
Spark job whose noise comes from a generator seeded by (seed, trial), so the data don't
depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import ParameterError


@dataclass(frozen=True)
class Truth:
    names: tuple[str, ...]
    weights: list[np.ndarray]
    bases: list[np.ndarray]
    intercept: np.ndarray
    precision: np.ndarray
    x: np.ndarray

    @property
    def coefficients(self) -> list[np.ndarray]:
        return [w @ s.T for w, s in zip(self.weights, self.bases, strict=True)]


def smooth_kernel(bins: int, length_scale: float) -> np.ndarray:
    t = np.arange(bins)
    return np.exp(-0.5 * ((t[:, None] - t[None]) / length_scale) ** 2)


def _factor(kernel: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(kernel)
    return vectors * np.sqrt(np.maximum(values, 0))


def level_values(levels: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Rows of the level grid, the first regressor fastest, without building the grid."""
    out, rest = np.empty((len(index), len(levels))), index.copy()
    for p, values in enumerate(levels):
        out[:, p] = np.asarray(values)[rest % len(values)]
        rest //= len(values)
    return out


def draw_truth(n_neurons=100, n_bins=15, n_trials=100, ranks=(2, 1, 3), levels=None, length_scale=2.0, amplitude=1.0, noise_precision=None, condition_independent=True, seed=0) -> Truth:
    rng = np.random.default_rng(seed)
    if any(r < 0 or r > min(n_neurons, n_bins) for r in ranks):
        raise ParameterError("ranks lie between 0 and the smaller of neurons and bins")
    levels = levels or [np.array([-2.0, -1.0, 1.0, 2.0])] * (len(ranks) - 1) + [np.array([-1.0, 1.0])]
    total = int(np.prod([len(v) for v in levels]))
    x = level_values([np.asarray(v, float) for v in levels], rng.integers(0, total, n_trials))
    factor = _factor(smooth_kernel(n_bins, length_scale))
    bases = [amplitude * factor @ rng.standard_normal((n_bins, r)) for r in ranks]
    weights = [rng.standard_normal((n_neurons, r)) for r in ranks]
    intercept = (rng.standard_normal((n_neurons, 1)) * (factor @ rng.standard_normal(n_bins))[None]) if condition_independent else np.zeros((n_neurons, n_bins))
    precision = rng.exponential(1.25, n_neurons) + 0.05 if noise_precision is None else np.broadcast_to(noise_precision, n_neurons).astype(float)
    return Truth(tuple(f"x{i}" for i in range(len(ranks))), weights, bases, intercept, precision, x)


def simulate(spark: SparkSession, truth: Truth, drop_prob: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(obs, design); a neuron-trial is dropped with drop_prob, but each trial keeps one neuron at least."""
    if not 0 <= drop_prob < 1:
        raise ParameterError("drop_prob lies in [0, 1)")
    design = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(truth.x)], "trial_id long, x array<double>")
    b, intercept, sd = np.stack(truth.coefficients), truth.intercept, 1 / np.sqrt(truth.precision)

    def run(batches):
        for batch in batches:
            for trial, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng([seed, trial])
                y = intercept + np.einsum("p,pnt->nt", np.array(x), b) + sd[:, None] * rng.standard_normal(intercept.shape)
                seen = rng.random(len(y)) >= drop_prob
                seen[rng.integers(len(y))] |= not seen.any()
                own = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), trial)), pa.array(own), pa.array(list(y[own]), pa.list_(pa.float64()))], ["trial_id", "neuron_id", "y"])

    return design.mapInArrow(run, "trial_id long, neuron_id long, y array<double>"), design
