"""The estimator: fit frames, choose ranks, then score, predict, project and decode on Spark."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LISTED, DecodingWarning, DesignWarning, NotFittedError, ParameterError, ProjectionWarning, ValidationError, listed
from ..functions import criteria, kernels, subspaces
from ..operators import evaluate
from ..operators.moments import Moments, collected, moments
from ..operators.prepare import check_design, deficient_message, empty_message, empty_trials, first_ids
from ..sources.frames import checked_design, fit_checks, observation_floor, observed
from .distributed import candidate_fits
from .fit import fit_least_squares, fit_marginal
from .search import greedy_search

#: Bytes of collected moments that the driver takes.
MOST_MOMENT_BYTES = 256 << 20


@dataclass
class LowRankRegression:
    """y[trial, neuron, bin] = intercept[neuron, bin] + sum_p x[trial, p] (W_p S_p^T)[neuron, bin] + noise."""

    ranks: str | list | dict = "aic"
    estimator: str = "mmle"
    condition_independent: bool = True
    max_rank: int | None = None
    min_observations: int = 2
    ridge: float = 0.0
    basis_ridge: float = 0.0
    rank_search_init: str | list = "svd_weighted"
    rank_search_threshold: float = 0.0
    rank_search_warm_start: bool = True
    ecme_max_iter: int = 100
    ecme_tol: float = 1.0
    refine_max_iter: int = 10
    refine_tol: float = 1e-4
    convergence_eps: float = 1e-12
    optimizer_max_iter: int = 2000
    optimizer_tol: float = 1e-6
    optimizer_progtol: float = 1e-9
    canonicalize: bool = True
    n_jobs: int | None = None

    def get_params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def set_params(self, **params) -> "LowRankRegression":
        known, old = {f.name for f in fields(self)}, self.get_params()
        if odd := set(params) - known:
            raise ParameterError(f"unknown parameters {sorted(odd)}")
        try:
            for k, v in params.items():
                setattr(self, k, v)
            self._check()
        except Exception:  # whatever the check stumbled on, the old values hold again
            for k, v in old.items():
                setattr(self, k, v)
            raise
        return self

    def __getattr__(self, name: str):
        if name.endswith("_") and not name.startswith("_"):
            raise NotFittedError(f"{name} exists after fit")
        raise AttributeError(name)

    def _check(self) -> None:
        if self.estimator not in ("mmle", "svd"):
            raise ParameterError("estimator is 'mmle' or 'svd'")
        for name in ("ridge", "basis_ridge", "rank_search_threshold"):
            v = getattr(self, name)
            if isinstance(v, bool) or not (np.isfinite(v) and v >= 0):
                raise ParameterError(f"{name} is a finite number, at least 0")
        for name in ("min_observations", "ecme_max_iter", "refine_max_iter", "optimizer_max_iter"):
            v = getattr(self, name)
            if isinstance(v, bool) or int(v) != v or v < 1:
                raise ParameterError(f"{name} is a positive integer")
        for name in ("ecme_tol", "refine_tol", "convergence_eps", "optimizer_tol", "optimizer_progtol"):
            v = getattr(self, name)
            if not (np.isfinite(v) and v > 0):
                raise ParameterError(f"{name} is a positive number")
        if isinstance(self.ranks, str) and self.ranks != "aic":
            raise ParameterError("ranks is 'aic', a sequence or a mapping")
        if isinstance(self.rank_search_init, str) and self.rank_search_init not in ("svd_weighted", "svd", "ones"):
            raise ParameterError("rank_search_init is 'svd_weighted', 'svd', 'ones' or a sequence")

    def fit(self, rows: DataFrame, design: DataFrame, mask: str | None = None, names: list[str] | None = None) -> "LowRankRegression":
        """rows(trial_id, neuron_id, y [, mask]), design(trial_id, x)."""
        self._check()
        design = checked_design(design)
        p = len(design.first()["x"])
        neurons = rows.select("neuron_id").distinct()
        obs = observed(rows, mask)
        fit_checks(obs, neurons, observation_floor(self.min_observations, self.estimator, p, self.condition_independent))
        report = check_design(design, obs, names, self.condition_independent, self.basis_ridge, self.estimator, per_neuron=False)
        if report.problems:
            raise ValidationError("; ".join(report.problems))
        found = [*report.warnings, *filter(None, [empty_message(empty_trials(design, obs))])]
        if found:
            warnings.warn("; ".join(found), DesignWarning, stacklevel=2)
        stats = moments(obs, design)
        n = neurons.count()
        t = len(obs.first()["y"])
        if 8 * n * (p * p + p * t + p + t + 2) > MOST_MOMENT_BYTES:
            raise ValidationError("the moments exceed the driver's bound; use plans.distributed on the frames")
        m = collected(stats, neurons)
        _, deficient = kernels.solve_least_squares(*kernels.normal_equations(m, self.condition_independent, self.ridge))
        if deficient.any():
            warnings.warn(deficient_message(listed(m.ids[deficient])), DesignWarning, stacklevel=2)
        return self._fit_moments(m, report.names, rows.sparkSession)

    def fit_moments(self, m: Moments, names: list[str] | None = None, spark=None) -> "LowRankRegression":
        self._check()
        return self._fit_moments(m, tuple(names or (f"x{i}" for i in range(m.shape[1]))), spark)

    def _fit_moments(self, m: Moments, names: tuple[str, ...], spark) -> "LowRankRegression":
        n, p, t = m.shape
        top = min(n, t) if self.max_rank is None else int(self.max_rank)
        if not 1 <= top <= min(n, t):
            raise ParameterError(f"max_rank lies between 1 and {min(n, t)}")
        ls = dict(ridge=self.ridge, condition_independent=self.condition_independent)
        mm = dict(
            ls,
            ecme_max_iter=self.ecme_max_iter,
            ecme_tol=self.ecme_tol,
            refine_max_iter=self.refine_max_iter,
            refine_tol=self.refine_tol,
            eps=self.convergence_eps,
            optimizer_max_iter=self.optimizer_max_iter,
            optimizer_tol=self.optimizer_tol,
            optimizer_progtol=self.optimizer_progtol,
            basis_ridge=self.basis_ridge,
        )
        history = None
        if self.ranks == "aic":
            fit, history = self._search(m, names, top, ls, mm, spark)
        else:
            ranks = [self.ranks[k] for k in names] if isinstance(self.ranks, dict) else list(self.ranks)
            if len(ranks) != p or any(r < 0 or r > top for r in ranks):
                raise ParameterError(f"ranks need one value from 0 to {top} for each of {names}")
            fit = fit_marginal(m, ranks, **mm) if self.estimator == "mmle" else fit_least_squares(m, ranks, **ls)
        self.names_, self.ranks_, self.history_, self.fit_ = names, dict(zip(names, fit.ranks, strict=True)), history, fit
        self.neuron_ids_, self.n_obs_ = m.ids, m.n
        self.B_ = dict(zip(names, fit.coefficients, strict=True))
        pairs = zip(names, fit.weights, fit.bases, strict=True)
        self.W_, self.S_ = {}, {}
        for name, w, s in pairs:
            self.W_[name], self.S_[name] = subspaces.canonical_factors(w @ s.T, w.shape[1]) if self.canonicalize else (w, s)
        self.intercept_ = fit.intercept if fit.intercept is not None else np.zeros((n, t))
        self.noise_precision_ = fit.precision
        self.log_likelihood_ = fit.log_likelihood
        self.converged_ = getattr(fit, "converged", True)
        count = criteria.count_marginal if self.estimator == "mmle" else criteria.count_least_squares
        self.n_parameters_ = count(fit.ranks, n, t, condition_independent=self.condition_independent)
        self.aic_ = criteria.aic(fit.log_likelihood, self.n_parameters_)
        return self

    def _search(self, m, names, top, ls, mm, spark):
        n, p, t = m.shape
        init = self.rank_search_init
        seed = None
        if isinstance(init, str) and init != "ones" or self.estimator == "svd":
            weighted = init == "svd_weighted" and self.estimator == "mmle"
            fit = lambda r: fit_least_squares(m, r, precision_weighted=weighted, **ls)
            best, seed = greedy_search(fit, lambda f, r: f.aic, [1] * p if isinstance(init, str) else init, top, self.rank_search_threshold, names)
            if self.estimator == "svd":
                return best, seed
        start = seed.ranks[-1] if seed else [1] * p if init == "ones" else init
        current: dict = {}

        def warm(ranks):
            accepted = current.get("fit")
            if accepted is None or not self.rank_search_warm_start:
                return None
            fresh = fit_least_squares(m, ranks, **ls)
            bases = [s if s.shape[1] == r else np.column_stack((s, f[:, -1])) for s, f, r in zip(accepted.bases, fresh.bases, ranks, strict=True)]
            return bases, accepted.precision, accepted.intercept

        def fit(ranks):
            out = fit_marginal(m, ranks, warm(ranks), **mm)
            current.setdefault("fit", out)
            return out

        def many(trials):
            if self.n_jobs in (None, 1) or spark is None or len(trials) < 2:
                fits = [fit_marginal(m, r, warm(r), **mm) for r in trials]
            else:
                fits = candidate_fits(spark, m, trials, inits=[warm(r) for r in trials], **mm)
            current["round"] = dict(zip(trials, fits, strict=True))
            return fits

        def took(step, ranks, score):
            current["fit"] = current["round"][ranks]

        score = lambda f, r: criteria.aic(f.log_likelihood, criteria.count_marginal(r, n, t, condition_independent=self.condition_independent, formula="reference"))
        best, history = greedy_search(fit, score, start, top, self.rank_search_threshold, names, fit_many=many, callback=took)
        return best, type(history)(**{**history.__dict__, "seed": seed})

    def aic(self) -> float:
        return self.aic_

    def params_frame(self, spark) -> DataFrame:
        """(neuron_id, b, intercept, noise_precision): what the evaluation operators join."""
        b = np.stack([self.B_[k] for k in self.names_], axis=1)
        rows = [(int(i), b[k].ravel().tolist(), self.intercept_[k].tolist(), float(self.noise_precision_[k])) for k, i in enumerate(self.neuron_ids_)]
        return spark.createDataFrame(rows, "neuron_id long, b array<double>, intercept array<double>, noise_precision double")

    def _evaluated(self, rows: DataFrame, mask: str | None, design: DataFrame | None = None) -> DataFrame:
        """The observations, once they are known to fit the model: its neurons, bins and regressors, a design row each."""
        obs = observed(rows, mask)
        n, p, t = len(self.neuron_ids_), len(self.names_), self.intercept_.shape[1]
        ids = rows.sparkSession.createDataFrame([(int(i),) for i in self.neuron_ids_], "neuron_id long")
        strange = obs.select("neuron_id").distinct().join(ids, "neuron_id", "left_anti").orderBy("neuron_id").limit(LISTED + 1).collect()
        if strange:
            raise ValidationError(f"neurons that aren't among the {n} fitted ones: {listed(r[0] for r in strange)}")
        if obs.where(F.size("y") != t).limit(1).count():
            raise ValidationError(f"responses must have {t} bins, as in fit")
        if design is not None:
            self._check_width(design, p)
            lost = obs.select("trial_id").distinct().join(design.select("trial_id"), "trial_id", "left_anti").orderBy("trial_id").limit(LISTED + 1).collect()
            if lost:
                raise ValidationError(f"trials without a design row: {listed(r[0] for r in lost)}")
        return obs

    @staticmethod
    def _check_width(design: DataFrame, p: int) -> None:
        if design.where(F.size("x") != p).limit(1).count():
            raise ValidationError(f"the design must have {p} columns, as in fit")

    def predict(self, design: DataFrame) -> DataFrame:
        self._check_width(design, len(self.names_))
        return evaluate.predict(design, self.params_frame(design.sparkSession))

    def log_likelihood(self, rows: DataFrame, design: DataFrame, mask: str | None = None, per_trial: bool = False) -> DataFrame:
        return evaluate.log_likelihood(self._evaluated(rows, mask, design), design, self.params_frame(rows.sparkSession), per_trial, rows.select("trial_id").distinct())

    def score(self, rows: DataFrame, design: DataFrame, mask: str | None = None) -> float:
        return self.log_likelihood(rows, design, mask).first()[0]

    def explained_variance(self, rows: DataFrame, design: DataFrame, mask: str | None = None, per_bin: bool = False) -> DataFrame:
        return evaluate.explained_variance(self._evaluated(rows, mask, design), design, self.params_frame(rows.sparkSession), list(self.names_), per_bin)

    def weights_frame(self, spark, names: list[str]) -> DataFrame:
        w = np.column_stack([self.W_[k] for k in names])
        return spark.createDataFrame([(int(i), w[k].tolist()) for k, i in enumerate(self.neuron_ids_)], "neuron_id long, w array<double>")

    def project(self, rows: DataFrame, regressor: str | None, mask: str | None = None, remove_intercept: bool = True, weighted: bool = True, method: str = "gls") -> DataFrame:
        """Coordinates of one regressor, or with None of all jointly."""
        names = [regressor] if regressor else [k for k in self.names_ if self.W_[k].shape[1]]
        spark, obs = rows.sparkSession, self._evaluated(rows, mask)
        if absent := self._unobserved(rows, obs):
            warnings.warn(f"trials without an observation have no projection: {absent}", ProjectionWarning, stacklevel=2)
        return evaluate.project(obs, self.weights_frame(spark, names), self.params_frame(spark), remove_intercept, weighted, method, rows.select("trial_id"))

    def decode(self, rows: DataFrame, regressors: list[str], mask: str | None = None, known: DataFrame | None = None, levels: dict[str, list[float]] | None = None, bins=None) -> DataFrame:
        at = {k: i for i, k in enumerate(self.names_)}
        obs = self._evaluated(rows, mask)
        if absent := self._unobserved(rows, obs):
            warnings.warn(f"trials without an observation have no decoded value: {absent}", DecodingWarning, stacklevel=2)
        return evaluate.decode(obs, self.params_frame(rows.sparkSession), len(at), [at[k] for k in regressors], {at[k]: v for k, v in (levels or {}).items()}, known, bins, rows.select("trial_id"))

    @staticmethod
    def _unobserved(rows: DataFrame, obs: DataFrame) -> str:
        return first_ids(empty_trials(rows, obs), "trial_id")

    def orthogonalize(self, order: list[str]) -> dict[str, np.ndarray]:
        return subspaces.orthogonalize(self.W_, order)

    def subspace_angles(self, a: str, b: str) -> np.ndarray:
        return subspaces.subspace_angles(self.W_[a], self.W_[b])
