"""Likelihood, gradients, posterior and candidate fits as Spark jobs, with the same kernels.

A job maps Arrow batches of moment rows to partial sums; the driver adds the partials in
partition order, so repeated runs give the same floating-point sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import kernels as K
from ..operators.moments import Moments, parts_of
from .fit import fit_least_squares, fit_marginal, marginal_gradients


def _of(batch: pa.RecordBatch) -> Moments:
    return Moments(*parts_of(pa.Table.from_batches([batch])))


def marginal_value_and_gradient(stats: DataFrame, bases: list[np.ndarray], params: DataFrame) -> tuple[float, list[np.ndarray]]:
    """Negative log-likelihood and its gradient in the bases; params: neuron_id, precision, intercept array."""
    joined = stats.join(params, "neuron_id")
    columns = stats.columns

    def run(batches):
        from pyspark import TaskContext

        value, grads = 0.0, [np.zeros_like(s) for s in bases]
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _of(batch.select(columns))
            lam = batch.column("precision").to_numpy()
            b = batch.column("intercept").flatten().to_numpy(zero_copy_only=False).reshape(len(lam), -1)
            v, g, _ = marginal_gradients(bases, lam, b, m)
            value += v
            grads = [x + y for x, y in zip(grads, g, strict=True)]
        flat = np.concatenate([g.ravel() for g in grads])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([value]), pa.array([flat.tolist()], pa.list_(pa.float64()))], ["part", "value", "grad"])

    rows = sorted(joined.mapInArrow(run, "part long, value double, grad array<double>").collect(), key=lambda r: r["part"])
    total = np.sum([r["grad"] for r in rows], axis=0)
    ends = np.cumsum([s.size for s in bases])
    return float(np.sum([r["value"] for r in rows])), [g.reshape(s.shape) for g, s in zip(np.split(total, ends[:-1]), bases, strict=True)]


def coefficients_full(stats: DataFrame, ridge: float = 0.0, intercept: bool = True) -> DataFrame:
    """Per-neuron least squares, no data on the driver: (neuron_id, b array (regressors x bins), intercept, precision, log_likelihood)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _of(batch)
            beta, _ = K.solve_least_squares(*K.normal_equations(m, intercept, ridge))
            if intercept:
                rss, level = K.residual(m.xtx, m.xty, m.yty, beta), np.nan_to_num(m.y_mean) - np.einsum("np,npt->nt", np.nan_to_num(m.x_mean), beta)
            else:
                rss, level = K.residual(m.xtx_raw(), *m.about(None), beta), np.zeros((m.shape[0], m.shape[2]))
            counts = m.n * m.shape[2]
            ll = -0.5 * counts * (np.log(rss / counts) + 1 + np.log(2 * np.pi))
            lists = lambda v: pa.array(list(v.reshape(len(rss), -1)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(m.ids), lists(beta), lists(level), pa.array(counts / rss), pa.array(ll)], ["neuron_id", "b", "intercept", "noise_precision", "log_likelihood"])

    return stats.mapInArrow(run, "neuron_id long, b array<double>, intercept array<double>, noise_precision double, log_likelihood double")


def candidate_fits(spark: SparkSession, m: Moments, trials: list[tuple[int, ...]], estimator: str = "mmle", inits: list | None = None, **options) -> list:
    """A search round's fits, one Spark task each; results come back in the order of trials."""
    import pickle

    shared = spark.sparkContext.broadcast((m, options, inits))
    rows = spark.createDataFrame([(i, list(r)) for i, r in enumerate(trials)], "i int, ranks array<int>").repartition(len(trials), "i")

    def run(batches):
        for batch in batches:
            moments, opts, starts = shared.value
            fitted = fit_marginal if estimator == "mmle" else fit_least_squares
            for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = {"init": starts[i]} if starts and starts[i] is not None else {}
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps(fitted(moments, r, **more, **opts))], pa.binary())], ["i", "fit"])

    found = sorted(rows.mapInArrow(run, "i int, fit binary").collect(), key=lambda r: r["i"])
    shared.unpersist()
    return [pickle.loads(r["fit"]) for r in found]
