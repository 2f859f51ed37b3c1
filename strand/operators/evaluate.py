"""Prediction, scores, projection and decoding as DataFrame operators.

params(neuron_id, b array (regressors x bins, row-major), intercept array, noise_precision).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..sources.frames import with_design
from .moments import Moments, grouped_moments, parts_of

#: Level combinations a discrete decoder may enumerate.
MOST_COMBINATIONS = 64


def predicted(rows: DataFrame) -> DataFrame:
    """rows (x, b, intercept) with `fit`: intercept + sum of x_p b_p, per bin."""
    bins = F.size("intercept")
    value = lambda level, t: level + F.aggregate(
        F.transform("x", lambda x, p: x * F.get("b", p * bins + t)), F.lit(0.0), lambda a, v: a + v
    )
    return rows.withColumn("fit", F.transform("intercept", value))


def predict(design: DataFrame, params: DataFrame) -> DataFrame:
    """(trial_id, neuron_id, y): every trial and neuron, observed or not (the result itself is that product)."""
    return predicted(design.crossJoin(params)).select("trial_id", "neuron_id", F.col("fit").alias("y"))


def _residuals(obs: DataFrame, design: DataFrame, params: DataFrame) -> DataFrame:
    return predicted(with_design(obs, design).join(params, "neuron_id"))


def _squares(a: str, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def log_likelihood(obs: DataFrame, design: DataFrame, params: DataFrame, per_trial: bool = False, trials: DataFrame | None = None) -> DataFrame:
    """One row, or one per trial (NaN for the trials that hold no observation)."""
    rows = _residuals(obs, design, params)
    term = 0.5 * F.size("y") * (F.log("noise_precision") - float(np.log(2 * np.pi))) - 0.5 * F.col("noise_precision") * _squares("y", F.col("fit"))
    scored = rows.select("trial_id", term.alias("term"))
    if not per_trial:
        return scored.agg(F.sum("term").alias("log_likelihood"))
    out = scored.groupBy("trial_id").agg(F.sum("term").alias("log_likelihood"))
    if trials is None:
        return out
    return trials.select("trial_id").join(out, "trial_id", "left").withColumn("log_likelihood", F.coalesce("log_likelihood", F.lit(float("nan"))))


def _one_term(p: int, bins: Column):
    return lambda v, t: F.col("mean") + F.get("x", F.lit(p)) * F.get("b", p * bins + t)


def explained_variance(obs: DataFrame, design: DataFrame, params: DataFrame, names: list[str], per_bin: bool = False) -> DataFrame:
    """(term[, bin], explained): 1 - residual / variation about each neuron's mean over trials and bins.

    A regressor's term is the neuron's mean plus its own contribution; "intercept" is the
    intercept alone; "total" the whole prediction.
    """
    mean = obs.groupBy("neuron_id").agg((F.sum(F.aggregate("y", F.lit(0.0), lambda s, v: s + v)) / F.sum(F.size("y"))).alias("mean"))
    rows = _residuals(obs, design, params).join(mean, "neuron_id")
    bins = F.size("intercept")
    terms = [F.struct(F.lit("base").alias("term"), F.transform("y", lambda v, t: F.col("mean")).alias("guess"))]
    for p, name in enumerate(names):
        terms.append(F.struct(F.lit(name).alias("term"), F.transform("y", _one_term(p, bins)).alias("guess")))
    terms.append(F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("guess")))
    terms.append(F.struct(F.lit("total").alias("term"), F.col("fit").alias("guess")))
    flat = rows.select("y", F.explode(F.array(*terms)).alias("z")).select("y", "z.term", "z.guess")
    errors = flat.select("term", F.posexplode(F.zip_with("y", "guess", lambda a, g: (a - g) * (a - g))).alias("bin", "e"))
    keys = ["term", "bin"] if per_bin else ["term"]
    sums = errors.groupBy(*keys).agg(F.sum("e").alias("e"))
    base = sums.where("term = 'base'").select(*keys[1:], F.col("e").alias("e0"))
    rest = sums.where("term <> 'base'")
    joined = rest.join(base, "bin") if per_bin else rest.crossJoin(base)  # one row
    return joined.select(*keys, (1 - F.col("e") / F.col("e0")).alias("explained"))


def coefficient_norms(coef: DataFrame) -> DataFrame:
    """(regressor, bin, norm) from coef(regressor, neuron_id, b array)."""
    return coef.select("regressor", F.posexplode("b").alias("bin", "v")).groupBy("regressor", "bin").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def _grouped(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel on each trial's rows; a trial's observed neurons bound its group."""

    def run(group: pa.Table) -> pa.Table:
        return kernel(group.sort_by("neuron_id"))

    return rows.groupBy("trial_id").applyInArrow(run, schema)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table.column(name).to_pylist(), dtype=np.float64).reshape(table.num_rows, -1)


def _missing(width: int) -> Column:
    return F.array_repeat(F.lit(float("nan")), width)


def project(obs: DataFrame, weights: DataFrame, params: DataFrame, remove_intercept: bool = True, weighted: bool = True, method: str = "gls", trials: DataFrame | None = None) -> DataFrame:
    """(trial_id, z array (bins x components)): each trial's coordinates in the column space of weights(neuron_id, w array).

    gls solves the (precision-weighted) normal equations over the observed neurons, NaN
    where they are singular; paper sums w_i y_i without solving. With trials, those that
    hold no observation have rows too: NaN by gls, the empty sum 0 by paper.
    """
    if method not in ("gls", "paper"):
        raise ParameterError(f"method must be 'gls' or 'paper'; got {method!r}")
    rows = obs.join(weights, "neuron_id").join(params.select("neuron_id", "intercept", "noise_precision"), "neuron_id")
    if remove_intercept:
        rows = rows.withColumn("y", F.zip_with("y", "intercept", lambda v, c: v - c))
    root = F.sqrt("noise_precision") if weighted and method == "gls" else F.lit(1.0)
    # each trial is a regression of its neurons' responses on their weights: its sums add up over tasks as a neuron's do over trials
    sums = grouped_moments(rows.select(F.col("trial_id").alias("neuron_id"), F.transform("w", lambda v: v * root).alias("x"), F.transform("y", lambda v: v * root).alias("y")))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = Moments(*parts_of(pa.Table.from_batches([batch])))
            g, z, _ = m.raw()
            if method == "gls":
                e = np.linalg.eigvalsh(g)
                fine = (m.n >= g.shape[1]) & (e[:, 0] > np.finfo(float).eps * e[:, -1])
                z[fine] = np.linalg.solve(g[fine], z[fine])
                z[~fine] = np.nan
            yield pa.RecordBatch.from_arrays([pa.array(m.ids), pa.array(list(z.transpose(0, 2, 1).reshape(len(z), -1)), pa.list_(pa.float64()))], ["trial_id", "z"])

    out = sums.mapInArrow(run, "trial_id long, z array<double>")
    if trials is None:
        return out
    width = len(weights.first()["w"]) * len(params.first()["intercept"])
    empty = _missing(width) if method == "gls" else F.array_repeat(F.lit(0.0), width)
    return trials.select("trial_id").distinct().join(out, "trial_id", "left").withColumn("z", F.coalesce("z", empty))


def decode(obs: DataFrame, params: DataFrame, n_regressors: int, decoded: list[int], levels: dict[int, list[float]] | None = None, known: DataFrame | None = None, bins: list[int] | None = None, trials: DataFrame | None = None) -> DataFrame:
    """(trial_id, values array by decoded regressor, log_likelihood, profile array, llr).

    Continuous regressors are solved jointly; discrete ones (with levels) by the profile
    over all their combinations, the first maximum winning. known(trial_id, x array)
    holds the regressors that aren't decoded. llr is profile[1] - profile[0] for one
    two-level regressor, else null. Singular trials give NaN, and with trials so do those
    that hold no observation.
    """
    levels = levels or {}
    discrete = [p for p in decoded if p in levels]
    continuous = [p for p in decoded if p not in levels]
    n_combinations = int(np.prod([len(levels[p]) for p in discrete])) if discrete else 1
    if n_combinations > MOST_COMBINATIONS:
        raise ParameterError(f"{n_combinations} level combinations; at most {MOST_COMBINATIONS}")
    if known is None and set(decoded) != set(range(n_regressors)):
        raise ParameterError("regressors that aren't decoded must be known")
    combinations = list(itertools.product(*(levels[p] for p in discrete)))
    rows = obs.join(params, "neuron_id")
    rows = rows.join(known.select("trial_id", F.col("x").alias("known")), "trial_id") if known is not None else rows.withColumn("known", F.array(*[F.lit(0.0)] * n_regressors))

    def kernel(t: pa.Table) -> pa.Table:
        y, b0 = _matrix(t, "y"), _matrix(t, "intercept")
        b = _matrix(t, "b").reshape(t.num_rows, n_regressors, -1)
        use = range(y.shape[1]) if bins is None else [k % y.shape[1] for k in bins]
        y, b0, b = y[:, use], b0[:, use], b[:, :, use]
        lam = t.column("noise_precision").to_numpy()
        fixed = np.array(t.column("known")[0].as_py(), dtype=np.float64)
        fixed[decoded] = 0
        g = np.einsum("n,npt,nqt->pq", lam, b, b)[np.ix_(continuous, continuous)] if continuous else np.empty((0, 0))
        e = np.linalg.eigvalsh(g) if continuous else np.ones(1)
        fine = e[0] > np.sqrt(np.finfo(float).eps) * e[-1]
        values, profile = [], []
        for combo in combinations:
            x = fixed.copy()
            x[discrete] = combo
            if continuous and fine:
                rest = y - b0 - np.einsum("p,npt->nt", x, b)
                x[continuous] = np.linalg.solve(g, np.einsum("n,npt,nt->p", lam, b[:, continuous], rest))
            rest = y - b0 - np.einsum("p,npt->nt", x, b)
            ll = 0.5 * (y.shape[1] * (np.log(lam) - np.log(2 * np.pi)) - lam * (rest * rest).sum(axis=1)).sum()
            values.append(x[decoded])
            profile.append(ll if fine else np.nan)
        best = int(np.argmax(profile)) if fine else 0
        llr = profile[1] - profile[0] if len(discrete) == 1 and len(combinations) == 2 else None
        chosen = values[best] if fine else np.full(len(decoded), np.nan)
        return pa.table(
            {
                "trial_id": t.column("trial_id")[:1],
                "values": pa.array([chosen.tolist()], pa.list_(pa.float64())),
                "log_likelihood": pa.array([profile[best]], pa.float64()),
                "profile": pa.array([profile], pa.list_(pa.float64())),
                "llr": pa.array([llr], pa.float64()),
            }
        )

    out = _grouped(rows, kernel, "trial_id long, values array<double>, log_likelihood double, profile array<double>, llr double")
    if trials is None:
        return out
    nan, two = F.lit(float("nan")), len(discrete) == 1 and n_combinations == 2
    filled = {"values": _missing(len(decoded)), "log_likelihood": nan, "profile": _missing(n_combinations), "llr": nan if two else F.lit(None)}
    joined = trials.select("trial_id").distinct().join(out, "trial_id", "left")
    return joined.withColumns({c: F.coalesce(c, v) for c, v in filled.items()})
