"""Estimators on moments: least squares with truncation, ECME, coordinate ascent, and their pipeline."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np

from ..errors import ConvergenceWarning, ParameterError, ValidationError, listed
from ..functions import criteria
from ..functions import kernels as K
from ..functions.optim import minimize
from ..operators.moments import Moments


@dataclass(frozen=True)
class LeastSquaresFit:
    """Truncated least squares: weights and bases by regressor, coefficients (neurons, bins) by regressor."""

    ranks: tuple[int, ...]
    weights: list[np.ndarray]
    bases: list[np.ndarray]
    coefficients: list[np.ndarray]
    full_coefficients: np.ndarray
    intercept: np.ndarray | None
    full_intercept: np.ndarray | None
    precision: np.ndarray
    log_likelihood: float
    n_parameters: int
    aic: float
    deficient: tuple[int, ...] = ()


@dataclass(frozen=True)
class MarginalFit:
    """Marginal likelihood fit: bases, precisions, intercepts, and the weights' posterior."""

    ranks: tuple[int, ...]
    bases: list[np.ndarray]
    precision: np.ndarray
    intercept: np.ndarray | None
    weights: list[np.ndarray]
    weight_covariance: np.ndarray
    log_likelihood: float
    objective: float
    iterations: dict[str, int] = field(default_factory=dict)
    converged: bool = True
    trace: tuple[float, ...] = ()

    @property
    def coefficients(self) -> list[np.ndarray]:
        return [w @ s.T for w, s in zip(self.weights, self.bases, strict=True)]


def _ranks(ranks, m: Moments) -> tuple[int, ...]:
    n, p, t = m.shape
    ranks = tuple(int(r) for r in ranks)
    if len(ranks) != p or any(r < 0 or r > min(n, t) for r in ranks):
        raise ParameterError(f"ranks must be {p} integers from 0 to {min(n, t)}; got {ranks}")
    return ranks


def _rounding(energy: np.ndarray, bins: int) -> np.ndarray:
    return K.ROUNDING * np.finfo(float).eps * bins * energy


def reject_degenerate(m: Moments, rss: np.ndarray, energy: np.ndarray) -> None:
    bad = m.ids[~(rss > _rounding(energy, m.shape[2])) | (energy == 0)]
    if len(bad):
        raise ValidationError(f"no residual is left for neurons {listed(bad)}; their precision is unbounded")


def _aligned_rss(m: Moments, beta: np.ndarray, intercept: bool, ridge: float) -> np.ndarray:
    if not intercept:
        return K.residual(m.xtx_raw(), *m.about(None), beta)
    level = np.nan_to_num(m.y_mean) - np.einsum("np,npt->nt", np.nan_to_num(m.x_mean), beta)
    rest = level * (ridge / np.maximum(m.n + ridge, 1e-300))[:, None]
    return K.residual(m.xtx, m.xty, m.yty, beta) + m.n * (rest * rest).sum(axis=1)


def _level(m: Moments, beta: np.ndarray, ridge: float) -> np.ndarray:
    level = np.nan_to_num(m.y_mean) - np.einsum("np,npt->nt", np.nan_to_num(m.x_mean), beta)
    return level * (m.n / np.maximum(m.n + ridge, 1e-300))[:, None]


def _row_weights(m: Moments, beta: np.ndarray, intercept: bool, ridge: float) -> np.ndarray:
    rss = np.maximum(_aligned_rss(m, beta, intercept, ridge), np.finfo(float).tiny)
    d = np.sqrt(m.n * m.n * m.shape[2] / rss)
    return d / np.sqrt((d * d).mean())


def fit_least_squares(m: Moments, ranks=None, *, ridge: float = 0.0, condition_independent: bool = True, precision_weighted: bool = False) -> LeastSquaresFit:
    """Grouped least squares, each regressor's (neurons x bins) block truncated to its rank; ranks None: full."""
    n, p, t = m.shape
    ranks = _ranks([min(n, t)] * p if ranks is None else ranks, m)
    beta, deficient = K.solve_least_squares(*K.normal_equations(m, condition_independent, ridge))
    d = _row_weights(m, beta, condition_independent, ridge) if precision_weighted else np.ones(n)
    weights, bases = [], []
    for j, r in enumerate(ranks):
        u, s, v = K.signed_svd(d[:, None] * beta[:, j], r)
        weights.append(u * np.sqrt(s) / d[:, None])
        bases.append(v * np.sqrt(s))
    coefficients = [w @ s.T for w, s in zip(weights, bases, strict=True)]
    kept = np.stack(coefficients, axis=1)
    rss = _aligned_rss(m, kept, condition_independent, ridge)
    energy = m.yty if condition_independent else m.about(None)[1]
    reject_degenerate(m, rss, energy)
    counts = m.n * t
    precision = counts / rss
    ll = float(-0.5 * (counts * (np.log(rss / counts) + 1 + np.log(2 * np.pi))).sum())
    k = criteria.count_least_squares(ranks, n, t, condition_independent=condition_independent)
    level = (lambda b: _level(m, b, ridge)) if condition_independent else (lambda b: None)
    return LeastSquaresFit(ranks, weights, bases, coefficients, beta, level(kept), level(beta), precision, ll, k, criteria.aic(ll, k), tuple(m.ids[deficient].tolist()))


def _moments_about(m: Moments, b: np.ndarray | None):
    xty, yty = m.about(b)
    return m.xtx_raw(), xty, yty


def marginal_log_likelihood(bases, precision, intercept, m: Moments, basis_ridge: float = 0.0) -> float:
    b = K.blocks(bases)
    xtx, xty, yty = _moments_about(m, intercept)
    terms = K.nll_terms(K.state(b, precision, xtx, xty), precision, yty, m.n, m.shape[2])
    return float(-terms.sum() - basis_ridge * (b.s**2).sum())


def marginal_gradients(bases, precision, intercept, m: Moments, basis_ridge: float = 0.0):
    """(negative log-likelihood, gradient in each basis, gradient in each precision)."""
    b = K.blocks(bases)
    xtx, xty, yty = _moments_about(m, intercept)
    st = K.state(b, precision, xtx, xty)
    h, e = K.basis_sums(b, st, precision, xtx, xty)
    grad = b.s @ h - e + 2 * basis_ridge * b.s
    value = K.nll_terms(st, precision, yty, m.n, m.shape[2]).sum() + basis_ridge * (b.s**2).sum()
    return float(value), K.split(grad, b, len(bases)), K.precision_gradient(st, precision, yty, m.n, m.shape[2])


def posterior_weights(bases, precision, intercept, m: Moments):
    """Posterior means by regressor and the joint covariance; the prior for unobserved neurons."""
    b = K.blocks(bases)
    xtx, xty, _ = _moments_about(m, intercept)
    st = K.state(b, precision, xtx, xty)
    return K.split(st.mu, b, len(bases)), st.cov


def update_intercept(bases, precision, m: Moments) -> np.ndarray:
    return K.intercepts(K.blocks(bases), precision, m)


def at_parameters(m: Moments, bases, precision, intercept, basis_ridge: float = 0.0, **more) -> MarginalFit:
    weights, cov = posterior_weights(bases, precision, intercept, m)
    ll = marginal_log_likelihood(bases, precision, intercept, m)
    objective = -ll + basis_ridge * sum(float((s**2).sum()) for s in bases)
    return MarginalFit(tuple(s.shape[1] for s in bases), list(bases), precision, intercept, weights, cov, ll, objective, **more)


def _change(old, new, eps: float) -> float:
    parts = [((b - a) ** 2 / (a**2 + eps)).max(initial=0.0) for a, b in zip(old, new, strict=True) if a is not None]
    return float(max(parts, default=0.0))


def ecme_step(b: K.Blocks, lam: np.ndarray, intercept: np.ndarray | None, m: Moments):
    """Precisions, bases and intercepts, each at the newest values of the others."""
    t = m.shape[2]
    xtx, xty, yty = _moments_about(m, intercept)
    st = K.state(b, lam, xtx, xty)
    e = K.expected_residual(st, yty)
    if not (e > _rounding(yty, t)).all():
        raise ValidationError(f"the expected residual vanishes for neurons {listed(m.ids[~(e > _rounding(yty, t))])}")
    new = m.n * t / e
    s = b.s
    if b.s.shape[1]:
        h, c = K.basis_sums(b, K.state(b, new, xtx, xty), new, xtx, xty)
        chol = np.linalg.cholesky(h)
        s = np.linalg.solve(chol.T, np.linalg.solve(chol, c.T)).T
    stepped = K.Blocks(s, b.of)
    return stepped, new, None if intercept is None else K.intercepts(stepped, new, m)


#: Share by which rounding may raise the objective; an iteration that raised it by more hasn't converged.
RISE = 1e-9


def ecme(m: Moments, bases, precision, intercept, *, max_iter: int = 100, tol: float = 1.0, eps: float = 1e-12) -> MarginalFit:
    b, p = K.blocks(bases), len(bases)
    trace = [-marginal_log_likelihood(bases, precision, intercept, m)]
    done = max_iter == 0
    it, rose = 0, False
    while it < max_iter and not done:
        nb, nl, ni = ecme_step(b, precision, intercept, m)
        done = _change((precision, b.s, intercept), (nl, nb.s, ni), eps) < tol
        b, precision, intercept = nb, nl, ni
        trace.append(-marginal_log_likelihood(K.split(b.s, b, p), precision, intercept, m))
        rose = rose or trace[-1] > trace[-2] + RISE * max(1.0, abs(trace[-2]))
        it += 1
    return at_parameters(m, K.split(b.s, b, p), precision, intercept, iterations={"ecme": it}, converged=done and not rose, trace=tuple(trace))


def refine(m: Moments, start: MarginalFit, *, max_iter: int = 10, tol: float = 1e-4, eps: float = 1e-12, optimizer_max_iter: int = 2000, optimizer_tol: float = 1e-6, optimizer_progtol: float = 1e-9, basis_ridge: float = 0.0) -> MarginalFit:
    """Coordinate ascent: bases by quasi-Newton, precisions by Newton, intercepts in closed form.

    A step is taken only if the objective doesn't rise beyond rounding; converged says
    that the start had converged, every inner problem ended well and the change met tol.
    """
    p, t = len(start.bases), m.shape[2]
    b, lam, intercept = K.blocks(start.bases), start.precision, start.intercept
    scale = max(1.0, float((m.n * t).sum()))
    met, healthy, it, inner = max_iter == 0, True, 0, 0
    while it < max_iter and not met:
        old = (lam, b.s, intercept)
        xtx, xty, yty = _moments_about(m, intercept)

        def objective(x, lam=lam, xtx=xtx, xty=xty, yty=yty, of=b.of):
            at = K.Blocks(x.reshape(t, -1), of)
            try:
                st = K.state(at, lam, xtx, xty)
            except np.linalg.LinAlgError:
                return np.inf, np.zeros_like(x)
            h, c = K.basis_sums(at, st, lam, xtx, xty)
            value = K.nll_terms(st, lam, yty, m.n, t).sum() + basis_ridge * (x * x).sum()
            grad = at.s @ h - c + 2 * basis_ridge * at.s
            return value / scale, grad.ravel() / scale

        if b.s.size:
            found = minimize(objective, b.s.ravel(), tol=optimizer_tol, progress=optimizer_progtol, max_iter=optimizer_max_iter)
            inner += found.iterations
            healthy &= found.converged
            if found.value <= objective(b.s.ravel())[0] + 1e-10:
                b = K.Blocks(found.x.reshape(t, -1), b.of)
        st = K.state(b, lam, xtx, xty)
        lam, solved = K.precision_newton(st.k, st.u, yty, m.n, t, lam)
        healthy &= bool(solved.all())
        if intercept is not None:
            intercept = K.intercepts(b, lam, m)
        it += 1
        met = _change(old, (lam, b.s, intercept), eps) < tol
    fit = at_parameters(m, K.split(b.s, b, p), lam, intercept, basis_ridge, iterations={**start.iterations, "refine": it, "inner": inner}, converged=bool(met and healthy and start.converged), trace=start.trace)
    return fit


def require_fittable(m: Moments, intercept: bool) -> None:
    for bad, why in ((m.n == 0, "never observed"), (m.n < 1 + intercept, "observed once"), ((m.yty if intercept else m.about(None)[1]) == 0, "without energy")):
        if bad.any():
            raise ValidationError(f"neurons {why}: {listed(m.ids[bad])}")
    beta, _ = K.solve_least_squares(*K.normal_equations(m, intercept, 0.0))
    reject_degenerate(m, _aligned_rss(m, beta, intercept, 0.0), m.yty if intercept else m.about(None)[1])


def fit_marginal(m: Moments, ranks, init=None, *, condition_independent: bool = True, ecme_max_iter: int = 100, ecme_tol: float = 1.0, refine_max_iter: int = 10, refine_tol: float = 1e-4, eps: float = 1e-12, optimizer_max_iter: int = 2000, optimizer_tol: float = 1e-6, optimizer_progtol: float = 1e-9, ridge: float = 0.0, basis_ridge: float = 0.0) -> MarginalFit:
    """Start from truncated least squares (or init: bases, precision, intercept), ECME, refinement."""
    ranks = _ranks(ranks, m)
    require_fittable(m, condition_independent)
    if init is None:
        start = fit_least_squares(m, ranks, ridge=ridge, condition_independent=condition_independent)
        init = (start.bases, start.precision, m.y_mean if condition_independent else None)
    first = ecme(m, *init, max_iter=ecme_max_iter, tol=ecme_tol, eps=eps)
    fit = refine(m, first, max_iter=refine_max_iter, tol=refine_tol, eps=eps, optimizer_max_iter=optimizer_max_iter, optimizer_tol=optimizer_tol, optimizer_progtol=optimizer_progtol, basis_ridge=basis_ridge)
    if not fit.converged:
        warnings.warn(f"ranks {ranks}: stopped before convergence after {fit.iterations}", ConvergenceWarning, stacklevel=2)
    return replace(fit, ranks=ranks)
