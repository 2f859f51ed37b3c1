"""Condition averages, stacked sessions, splits, and the design report."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LISTED, ParameterError, listed
from ..functions import kernels as K
from ..sources.frames import observation_floor
from .moments import Moments, moments, parts_of

CORRELATION, SCALE, CENTRE_NOTE, CENTRE_WARNING = 0.95, 10.0, 0.1, 1.0
RANK_TOLERANCE = 1e-10


def conditions(design: DataFrame, by: list[int] | None = None) -> DataFrame:
    """(trial_id, cond_id): trials with equal values in the `by` columns, conditions in their order."""
    width = len(design.first()["x"])
    by = list(range(width)) if by is None else by
    if len(set(by)) != len(by) or any(not 0 <= k < width for k in by):
        raise ParameterError("`by` names each column once")
    key = F.struct(*[F.get("x", F.lit(k)).alias(f"k{k}") for k in by])
    keyed = design.select("trial_id", key.alias("key"))
    # the conditions are few beside the trials: ranks are given to distinct keys, not rows
    ranked = keyed.select("key").distinct().withColumn("cond_id", F.expr("cast(dense_rank() OVER (ORDER BY key) - 1 AS bigint)"))
    return keyed.join(ranked, "key").select("trial_id", "cond_id")


def condition_average(obs: DataFrame, design: DataFrame, neurons: DataFrame, by: list[int] | None = None, min_trials: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(averages, condition design, trial_cond).

    averages(cond_id, neuron_id, n_trials, mask, y): every condition and neuron; y is null
    where fewer than min_trials were observed. The condition's x is the mean over all its
    trials, observed or not.
    """
    if min_trials < 1:
        raise ParameterError("min_trials is a positive integer")
    trial_cond = conditions(design, by)
    cells = obs.join(trial_cond, "trial_id").select("cond_id", "neuron_id", F.posexplode("y").alias("bin", "v"))
    means = cells.groupBy("cond_id", "neuron_id", "bin").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    packed = means.groupBy("cond_id", "neuron_id").agg(F.max("n").alias("n_trials"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda s: s["v"]).alias("y"))
    grid = trial_cond.select("cond_id").distinct().crossJoin(neurons.select("neuron_id").distinct())  # the result's own shape
    out = grid.join(packed, ["cond_id", "neuron_id"], "left").withColumn("n_trials", F.coalesce("n_trials", F.lit(0).cast("long")))
    keep = F.col("n_trials") >= min_trials
    averages = out.select("cond_id", "neuron_id", "n_trials", keep.alias("mask"), F.when(keep, F.col("y")).alias("y"))
    xs = design.join(trial_cond, "trial_id").select("cond_id", F.posexplode("x").alias("p", "v")).groupBy("cond_id", "p").agg(F.avg("v").alias("v"))
    cond_x = xs.groupBy("cond_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("x"))
    return averages, cond_x, trial_cond


def stack_sessions(sessions: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(obs, design, trial_map, neuron_map): sessions with their own trials and neurons, re-numbered and united.

    Absent rows are the mask, so nothing is filled between the blocks.
    """
    if not sessions:
        raise ParameterError("at least one session is needed")
    trials = neurons = obs_all = design_all = None
    for s, (obs, design) in enumerate(sessions):
        own_t = design.select(F.lit(s).alias("session"), F.col("trial_id").alias("old")).distinct()
        own_n = obs.select(F.lit(s).alias("session"), F.col("neuron_id").alias("old")).distinct()
        trials = own_t if trials is None else trials.unionByName(own_t)
        neurons = own_n if neurons is None else neurons.unionByName(own_n)
        o, d = obs.withColumn("session", F.lit(s)), design.withColumn("session", F.lit(s))
        obs_all = o if obs_all is None else obs_all.unionByName(o)
        design_all = d if design_all is None else design_all.unionByName(d)
    number = "cast(row_number() OVER (ORDER BY session, old) - 1 AS bigint)"
    trial_map = trials.withColumn("trial_id", F.expr(number))
    neuron_map = neurons.withColumn("neuron_id", F.expr(number))
    t, n = trial_map.withColumnRenamed("trial_id", "nt"), neuron_map.withColumnRenamed("neuron_id", "nn")
    obs_out = obs_all.join(t, (obs_all["session"] == t["session"]) & (obs_all["trial_id"] == t["old"])).drop("old").drop(t["session"])
    obs_out = obs_out.join(n, (obs_out["session"] == n["session"]) & (obs_out["neuron_id"] == n["old"])).select(F.col("nt").alias("trial_id"), F.col("nn").alias("neuron_id"), "y")
    design_out = design_all.join(t, (design_all["session"] == t["session"]) & (design_all["trial_id"] == t["old"])).select(F.col("nt").alias("trial_id"), "x")
    return obs_out, design_out, trial_map, neuron_map


def split_trials(trials: DataFrame, test_fraction: float = 0.2, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """trials with `test`: in each stratum bround(fraction * size), at least 1 and at most size - 1; singletons train."""
    if not 0 < test_fraction < 1:
        raise ParameterError("test_fraction lies between 0 and 1")
    stratum = F.col(stratify) if stratify else F.lit(0)
    keyed = trials.withColumn("__s", stratum).withColumn("__h", F.xxhash64("trial_id", F.lit(seed)))
    # ranks within a stratum without sorting it in one task: counts per hash range give each range's first rank
    keyed = keyed.withColumn("__b", F.shiftrightunsigned("__h", 56))
    sizes = keyed.groupBy("__s", "__b").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("__s").alias("__bs"), F.col("__b").alias("__bb"), F.expr("coalesce(sum(n) OVER (PARTITION BY __s ORDER BY __b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("__before"), F.expr("sum(n) OVER (PARTITION BY __s)").alias("__m"))
    ranked = keyed.withColumn("__r", F.expr("row_number() OVER (PARTITION BY __s, __b ORDER BY __h, trial_id)"))
    joined = ranked.join(before, ranked["__s"].eqNullSafe(before["__bs"]) & (ranked["__b"] == before["__bb"]))
    size = F.when(F.col("__m") == 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.col("__m") - 1, F.bround(F.col("__m") * test_fraction))))
    return joined.withColumn("test", (F.col("__r") + F.col("__before")) <= size).select(*trials.columns, "test")


@dataclass(frozen=True)
class DesignReport:
    names: tuple[str, ...]
    n_trials: int
    means: np.ndarray
    stds: np.ndarray
    constant: tuple[str, ...]
    rank: int
    augmented_rank: int
    condition_number: float
    max_abs_correlation: float
    problems: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    duplicates: tuple[tuple[int, int], ...] = ()
    few_trial_neurons: DataFrame | None = None
    rank_deficient_neurons: DataFrame | None = None
    empty_trials: DataFrame | None = None

    def __str__(self) -> str:
        lines = [f"{self.n_trials} trials, rank {self.rank} of {len(self.names)}, condition number {self.condition_number:.3g}"]
        lines += [f"  {n}: mean {m:.4g}, std {s:.4g}" for n, m, s in zip(self.names, self.means, self.stds, strict=True)]
        return "\n".join([*lines, *(f"{k}: {x}" for k, v in (("problem", self.problems), ("warning", self.warnings), ("note", self.notes)) for x in v)])


def design_moments(design: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """One row: n, the first trial's x as shift, shifted means and co-moments of trials with an observation (all, if none)."""
    used = design
    if obs is not None:
        seen = design.join(obs.select("trial_id").distinct(), "trial_id", "left_semi")
        used = seen if seen.limit(1).count() else design
    shift = used.agg(F.min_by("x", "trial_id")).first()[0]
    p = len(shift)
    d = [(F.get("x", F.lit(k)) - F.lit(float(shift[k]))) for k in range(p)]
    sums = [F.avg(v).alias(f"m{k}") for k, v in enumerate(d)]
    pairs = [F.covar_pop(d[i], d[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    distinct = [F.count_distinct(F.get("x", F.lit(k))).alias(f"u{k}") for k in range(p)]
    return used.agg(F.count("*").alias("n"), *sums, *pairs, *distinct), shift


def design_neurons(obs: DataFrame, design: DataFrame, floor: int, condition_independent: bool = True, ridge: float = 0.0, neurons: DataFrame | None = None) -> DataFrame:
    """(neuron_id, n_obs, few_trials, rank_deficient): each neuron's own design, over the trials that observe it.

    Deficient is what least squares would call so: its Gram matrix, centred beside the
    intercept and with the ridge, has a zero eigenvalue at unit diagonal. With neurons,
    those never observed have too few trials, and no design that could be deficient.
    """
    zeros = obs.select("trial_id", "neuron_id", F.array(F.lit(0.0)).alias("y"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = Moments(*parts_of(pa.Table.from_batches([batch])))
                _, short = K.solve_least_squares(*K.normal_equations(m, condition_independent, ridge))
                yield pa.RecordBatch.from_arrays([pa.array(m.ids), pa.array(m.n), pa.array(m.n < floor), pa.array(short)], ["neuron_id", "n_obs", "few_trials", "rank_deficient"])

    out = moments(zeros, design).mapInArrow(run, "neuron_id long, n_obs long, few_trials boolean, rank_deficient boolean")
    if neurons is None:
        return out
    return neurons.select("neuron_id").distinct().join(out, "neuron_id", "left").na.fill({"n_obs": 0, "few_trials": True, "rank_deficient": False})


def empty_trials(design: DataFrame, obs: DataFrame) -> DataFrame:
    """(trial_id): trials of the design that no neuron was observed on."""
    return design.select("trial_id").distinct().join(obs.select("trial_id").distinct(), "trial_id", "left_anti")


def empty_message(trials: DataFrame) -> str | None:
    found = first_ids(trials, "trial_id")
    return f"trials without an observed neuron: {found}" if found else None


def deficient_message(neurons: str) -> str:
    return f"neurons whose observed design is rank-deficient: {neurons}; they get the least-norm solution unless ridge is positive"


def first_ids(df: DataFrame, column: str) -> str:
    """The smallest ids, and how many follow; empty without any."""
    ids = [r[0] for r in df.select(column).orderBy(column).limit(LISTED + 1).collect()]
    return listed(ids) if len(ids) <= LISTED else f"{listed(ids[:LISTED])} and {df.count() - LISTED} more"


def check_design(
    design: DataFrame,
    obs: DataFrame | None = None,
    names: list[str] | None = None,
    condition_independent: bool = True,
    basis_ridge: float = 0.0,
    estimator: str | None = None,
    min_observations: int = 2,
    ridge: float = 0.0,
    neurons: DataFrame | None = None,
    per_neuron: bool = True,
) -> DesignReport:
    """Ranks, conditioning, correlations and scales of the design; never raises for what it finds.

    With obs (and per_neuron) also frames of the neurons observed too seldom (the floor that
    the estimator's fit applies), of those whose own design is rank-deficient, and of the
    trials without observations; messages name the first of them. neurons names those that
    obs may lack.
    """
    if estimator not in (None, "mmle", "svd"):
        raise ParameterError("estimator is 'mmle', 'svd' or None")
    if isinstance(min_observations, bool) or int(min_observations) != min_observations or min_observations < 1:
        raise ParameterError("min_observations is a positive integer")
    if not (np.isfinite(ridge) and ridge >= 0):
        raise ParameterError("ridge is a finite number, at least 0")
    frame, shift = design_moments(design, obs)
    row, p = frame.first(), len(shift)
    names = tuple(names or (f"x{i}" for i in range(p)))
    n = row["n"]
    delta = np.array([row[f"m{k}"] for k in range(p)])
    means = delta + np.array(shift)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    stds = np.sqrt(np.maximum(np.diag(cov), 0))
    constant = stds == 0
    gram = cov + np.outer(means, means)

    def unit(g):
        d = np.sqrt(np.maximum(np.diag(g), 0))
        inv = np.divide(1, d, out=np.zeros_like(d), where=d > 0)
        return np.linalg.eigvalsh(g * inv * inv[:, None])

    eig = unit(gram)
    rank, augmented = int((eig > RANK_TOLERANCE).sum()), 1 + int((unit(cov) > RANK_TOLERANCE).sum())
    condition = float("inf") if eig[0] <= 0 or (np.diag(gram) == 0).any() else float(np.sqrt(eig[-1] / eig[0]))
    free = np.flatnonzero(~constant)
    corr = cov[np.ix_(free, free)] / np.outer(stds[free], stds[free]) if len(free) else np.empty((0, 0))
    off = np.abs(corr - np.diag(np.diag(corr)))
    problems, warns, notes = [], [], []
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    duplicates = tuple((a, b) for a in range(p) for b in range(a + 1, p) if size[a] * size[b] == 0 or 1 - abs(gram[a, b]) / (size[a] * size[b]) <= RANK_TOLERANCE)
    few = deficient = empty = None
    if rank < p:
        problems.append(f"the regressors have rank {rank} of {p}")
    if condition_independent and constant.any():
        problems.append("constant beside the intercept: " + ", ".join(np.array(names)[constant]))
    elif condition_independent and augmented < p + 1 and rank == p:
        problems.append("a combination of regressors is constant beside the intercept")
    if obs is not None and per_neuron:
        floor = observation_floor(min_observations, estimator, p, condition_independent)
        own = design_neurons(obs, design, floor, condition_independent, ridge, neurons).persist()
        few, deficient, empty = own.where("few_trials").select("neuron_id", "n_obs"), own.where("rank_deficient").select("neuron_id"), empty_trials(design, obs)
        if found := first_ids(few, "neuron_id"):
            problems.append(f"neurons observed on fewer than {floor} trials: {found}")
        if found := empty_message(empty):
            warns.append(found)
        if found := first_ids(deficient, "neuron_id"):
            warns.append(deficient_message(found))
        own.unpersist()
    for a in range(len(free)):
        for b in range(a + 1, len(free)):
            if off[a, b] > CORRELATION:
                warns.append(f"{names[free[a]]} and {names[free[b]]} correlate at {corr[a, b]:.3f}")
    if basis_ridge > 0 and len(free) > 1 and stds[free].max() > SCALE * stds[free].min():
        warns.append(f"standard deviations differ {stds[free].max() / stds[free].min():.3g}-fold")
    for k in range(p):
        if not constant[k] and abs(means[k]) > CENTRE_WARNING * stds[k] and row[f"u{k}"] > 2 and estimator == "mmle":
            warns.append(f"{names[k]} is far from centred")
        elif not constant[k] and abs(means[k]) > CENTRE_NOTE * stds[k] and row[f"u{k}"] > 2:
            notes.append(f"{names[k]} isn't centred")
    if basis_ridge == 0 and len(free) > 1 and stds[free].max() > SCALE * stds[free].min():
        notes.append(f"standard deviations differ {stds[free].max() / stds[free].min():.3g}-fold")
    return DesignReport(names, n, means, stds, tuple(np.array(names)[constant].tolist()), rank, augmented, condition, float(off.max(initial=0.0)), problems, warns, notes, duplicates, few, deficient, empty)
