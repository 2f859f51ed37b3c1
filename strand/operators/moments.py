"""Sufficient statistics: the one aggregation over the data.

A task sums its Arrow batches into centred moments per neuron, so each neuron leaves one
small row per task; rows merge pairwise exactly (counts, means, centred products). Every
neuron's rows are first shifted by a reference response and design (its first trial in
the batch), so large baselines cancel before any product is formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import with_design

SCHEMA = "neuron_id long, n_obs long, x_mean array<double>, y_mean array<double>, xtx_c array<double>, xty_c array<double>, yty_c double"


@dataclass(frozen=True)
class Moments:
    """Per neuron: counts n, means, and centred products; neurons in the order of ids."""

    ids: np.ndarray
    n: np.ndarray
    x_mean: np.ndarray
    y_mean: np.ndarray
    xtx: np.ndarray
    xty: np.ndarray
    yty: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int]:
        """(neurons, regressors, bins)"""
        return self.xty.shape

    def raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.xtx_raw(), *self.about(None)

    def xtx_raw(self) -> np.ndarray:
        x = _defined(self.x_mean)
        return self.xtx + self.n[:, None, None] * x[:, :, None] * x[:, None, :]

    def about(self, intercept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-moments and energies of the responses less an intercept per neuron and bin (none: zero)."""
        rest = _defined(self.y_mean) - (0 if intercept is None else intercept)
        x = _defined(self.x_mean)
        xty = self.xty + self.n[:, None, None] * x[:, :, None] * rest[:, None, :]
        return xty, self.yty + self.n * (rest * rest).sum(axis=1)


def _defined(means: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(means), 0.0, means)


def _rows(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _batch_moments(ids: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Moments of each distinct id in a batch."""
    order = np.argsort(ids, kind="stable")
    ids, x, y = ids[order], x[order], y[order]
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    n = np.diff(np.append(begin, len(ids)))
    of = np.repeat(np.arange(len(n)), n)
    x0, y0 = x[begin], y[begin]
    x, y = x - x0[of], y - y0[of]
    xm, ym = (np.add.reduceat(v, begin, axis=0) / n[:, None] for v in (x, y))
    x, y = x - xm[of], y - ym[of]
    xtx = np.add.reduceat(x[:, :, None] * x[:, None, :], begin, axis=0)
    xty = np.add.reduceat(x[:, :, None] * y[:, None, :], begin, axis=0)
    yty = np.add.reduceat((y * y).sum(axis=1), begin)
    return ids[begin], n.astype(np.int64), xm + x0, ym + y0, xtx, xty, yty


def merged(ids, n, xm, ym, xtx, xty, yty):
    """One row per id from rows that may share ids, by adding centred products and the spread of the means."""
    order = np.argsort(ids, kind="stable")
    ids, n, xm, ym, xtx, xty, yty = (v[order] for v in (ids, n, xm, ym, xtx, xty, yty))
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
    total = np.add.reduceat(n, begin)
    x0, y0 = xm[begin], ym[begin]
    dx, dy, w = xm - x0[of], ym - y0[of], n.astype(float)
    mx, my = (np.add.reduceat(w[:, None] * v, begin, axis=0) / total[:, None] for v in (dx, dy))
    dx, dy = dx - mx[of], dy - my[of]
    wx = w[:, None] * dx
    add = lambda v: np.add.reduceat(v, begin, axis=0)
    return (
        ids[begin],
        total,
        mx + x0,
        my + y0,
        add(xtx + wx[:, :, None] * dx[:, None, :]),
        add(xty + wx[:, :, None] * dy[:, None, :]),
        add(yty + w * (dy * dy).sum(axis=1)),
    )


def _batch(parts) -> pa.RecordBatch:
    ids, n, *arrays, yty = parts
    lists = [pa.array(list(v.reshape(len(ids), -1)), pa.list_(pa.float64())) for v in arrays]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), *lists, pa.array(yty)], ["neuron_id", "n_obs", "x_mean", "y_mean", "xtx_c", "xty_c", "yty_c"])


#: Partial rows a task holds before it merges them.
HELD = 4096


def _partial(batches):
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (_rows(batch.column(c), len(batch.column(c)[0])) for c in ("x", "y"))
        held.append(_batch_moments(batch.column("neuron_id").to_numpy(), x, y))
        size += len(held[-1][0])
        if size > HELD:
            held = [merged(*(np.concatenate(v) for v in zip(*held, strict=True)))]
            size = 0
    if held:
        yield _batch(merged(*(np.concatenate(v) for v in zip(*held, strict=True))))


def parts_of(table: pa.Table):
    """Arrays of moment rows."""
    p, t = (len(table.column(c)[0]) for c in ("x_mean", "y_mean"))
    n = table.num_rows
    return (
        table.column("neuron_id").to_numpy(),
        table.column("n_obs").to_numpy(),
        _rows(table.column("x_mean"), p),
        _rows(table.column("y_mean"), t),
        _rows(table.column("xtx_c"), p * p).reshape(n, p, p),
        _rows(table.column("xty_c"), p * t).reshape(n, p, t),
        table.column("yty_c").to_numpy(),
    )


def _merge_typed(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_batch(merged(*parts_of(table)))])


def moments(obs: DataFrame, design: DataFrame) -> DataFrame:
    """stats(neuron_id, n_obs, x_mean, y_mean, xtx_c, xty_c, yty_c): one shuffle, of one row per neuron and task."""
    return grouped_moments(with_design(obs, design))


def grouped_moments(rows: DataFrame) -> DataFrame:
    """The moments of rows(neuron_id, x, y); a task's batches are summed before the shuffle."""
    partial = rows.select("neuron_id", "x", "y").mapInArrow(_partial, SCHEMA)
    return partial.groupBy("neuron_id").applyInArrow(_merge_typed, SCHEMA)


def moments_sql(obs: DataFrame, design: DataFrame) -> DataFrame:
    """The same by built-in aggregates, in long form: (neuron_id, p, q, bin, n_obs, ...) kept JVM-side."""
    rows = with_design(obs, design)
    first = rows.groupBy("neuron_id").agg(F.min_by("x", "trial_id").alias("x0"), F.min_by("y", "trial_id").alias("y0"))
    shifted = rows.join(first, "neuron_id").select(
        "neuron_id",
        F.zip_with("x", "x0", lambda a, b: a - b).alias("dx"),
        F.zip_with("y", "y0", lambda a, b: a - b).alias("dy"),
        "x0",
        "y0",
    )
    cells = shifted.select("neuron_id", "dx", "x0", "y0", F.posexplode("dy").alias("bin", "dy")).select("neuron_id", "bin", "dy", F.get("y0", F.col("bin")).alias("y0"), F.posexplode(F.arrays_zip("dx", "x0")).alias("p", "z"))
    return cells.groupBy("neuron_id", "bin", "p").agg(
        F.count("*").alias("n_obs"),
        (F.first("z.x0") + F.avg("z.dx")).alias("x_mean"),
        (F.first("y0") + F.avg("dy")).alias("y_mean"),
        (F.var_pop("z.dx") * F.count("*")).alias("xx"),
        (F.covar_pop("z.dx", "dy") * F.count("*")).alias("xy"),
        (F.var_pop("dy") * F.count("*")).alias("yy"),
    )


def collected(stats: DataFrame, neurons: DataFrame | None = None, widths: tuple[int, int] | None = None) -> Moments:
    """The moments on the driver, by neuron id; never-observed neurons have zero products and NaN means."""
    table = stats.toArrow().combine_chunks()
    if table.num_rows:
        parts = parts_of(table.sort_by("neuron_id"))
    else:
        p, t = widths or (1, 1)
        parts = (np.empty(0, np.int64), np.empty(0, np.int64), *(np.empty((0, *s)) for s in ((p,), (t,), (p, p), (p, t), ())))
    out = Moments(*(np.ascontiguousarray(v) for v in parts))
    if neurons is None:
        return out
    ids = np.array(sorted(r[0] for r in neurons.select("neuron_id").distinct().collect()), dtype=np.int64)
    place = np.searchsorted(ids, out.ids)

    def spread(v, fill):
        full = np.full((len(ids), *v.shape[1:]), fill, dtype=v.dtype)
        full[place] = v
        return full

    return Moments(ids, spread(out.n, 0), spread(out.x_mean, np.nan), spread(out.y_mean, np.nan), spread(out.xtx, 0.0), spread(out.xty, 0.0), spread(out.yty, 0.0))


#: Neurons of dense arrays that are summed together.
NEURONS_AT_ONCE = 16


def from_arrays(y: np.ndarray, x: np.ndarray, mask: np.ndarray | None = None) -> Moments:
    """Moments of dense arrays y (trials, neurons, bins), x (trials, regressors)."""
    mask = ~np.isnan(y).any(axis=2) if mask is None else np.asarray(mask, bool)
    trials, n, t = y.shape
    p = x.shape[1]
    count = mask.sum(axis=0)
    some = np.where(count > 0, count, np.nan)
    centre = x.mean(axis=0) if trials else np.zeros(p)
    z = x - centre
    weight = mask.astype(float).T
    dx = weight @ z / some[:, None]
    products = (weight @ (z[:, :, None] * z[:, None, :]).reshape(trials, p * p)).reshape(n, p, p)
    xtx = products - count[:, None, None] * _defined(dx)[:, :, None] * _defined(dx)[:, None, :]
    y_mean, xty, yty = np.empty((n, t)), np.empty((n, p, t)), np.empty(n)
    for a in range(0, n, NEURONS_AT_ONCE):  # a few neurons at a time stay in the processor's cache
        own = slice(a, a + NEURONS_AT_ONCE)
        seen = mask[:, own, None]
        block = np.where(seen, y[:, own], 0.0)
        first = block.sum(axis=0) / some[own, None]
        rest = np.where(seen, block - _defined(first), 0.0)
        left = rest.sum(axis=0)
        width = rest.shape[1]
        cross = (z.T @ rest.reshape(trials, width * t)).reshape(p, width, t).transpose(1, 0, 2)
        xty[own] = cross - _defined(dx[own])[:, :, None] * left[:, None, :]
        yty[own] = np.einsum("abt,abt->b", rest, rest)
        y_mean[own] = first
    return Moments(np.arange(n), count.astype(np.int64), dx + centre, y_mean, xtx, xty, yty)
