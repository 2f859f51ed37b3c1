"""Kernels and fits against dense formulas, differences and recovery."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strand.errors import ParameterError, ValidationError
from strand.functions import criteria, kernels, subspaces
from strand.functions.optim import minimize
from strand.operators.moments import from_arrays, merged, _batch_moments
from strand.plans.estimator import LowRankRegression
from strand.plans.fit import ecme, fit_least_squares, fit_marginal, marginal_gradients, marginal_log_likelihood, posterior_weights, update_intercept
from strand.plans.search import greedy_search
from strand.sources.synth import draw_truth


def sample(seed=0, n=6, p=2, t=4, trials=40, drop=0.2, base=0.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((trials, p))
    y = base + rng.standard_normal((trials, n, t)) + np.einsum("kp,pnt->knt", x, rng.standard_normal((p, n, t)))
    y[rng.random((trials, n)) < drop] = np.nan
    return x, y


def naive(x, y, i):
    seen = ~np.isnan(y[:, i]).any(axis=1)
    xs, ys = x[seen], y[seen, i]
    xc, yc = xs - xs.mean(0), ys - ys.mean(0)
    return seen.sum(), xs.mean(0), ys.mean(0), xc.T @ xc, xc.T @ yc, (yc**2).sum()


@pytest.mark.parametrize("base", [0.0, 1e3, 1e6])
def test_moments_equal_loops(base):
    x, y = sample(base=base)
    m = from_arrays(y, x)
    for i in range(6):
        for a, b in zip((m.n[i], m.x_mean[i], m.y_mean[i], m.xtx[i], m.xty[i], m.yty[i]), naive(x, y, i), strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 39))
def test_moments_merge(seed, cut):
    x, y = sample(seed, drop=0.0)
    k, i = np.nonzero(np.ones(y.shape[:2], bool))
    parts = [_batch_moments(i[s], x[k[s]], y[k[s], i[s]]) for s in (k < cut, k >= cut)]
    both = merged(*(np.concatenate(v) for v in zip(*parts, strict=True)))
    for a, b in zip(both, _batch_moments(i, x[k], y[k, i]), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_never_observed_neuron():
    x, y = sample()
    y[:, 2] = np.nan
    m = from_arrays(y, x)
    assert m.n[2] == 0 and np.isnan(m.y_mean[2]).all() and not m.xtx[2].any()


def test_least_squares_full_rank_is_ols_and_deficient_is_least_norm():
    x, y = sample(drop=0.0)
    fit = fit_least_squares(from_arrays(y, x))
    a = np.column_stack((x, np.ones(len(x))))
    for i in range(6):
        beta = np.linalg.lstsq(a, y[:, i], rcond=None)[0]
        np.testing.assert_allclose(np.stack([c[i] for c in fit.coefficients]), beta[:-1], atol=1e-9)
        np.testing.assert_allclose(fit.intercept[i], beta[-1], atol=1e-9)
    twice = fit_least_squares(from_arrays(y, np.column_stack((x, x[:, 0]))))
    assert len(twice.deficient) == 6
    np.testing.assert_allclose(twice.full_coefficients[:, 0], twice.full_coefficients[:, 2], atol=1e-9)


def dense(x, y, s, lam, b, i):
    seen = ~np.isnan(y[:, i]).any(axis=1)
    r = (y[seen, i] - b[i]).ravel()
    phi = np.column_stack([np.kron(x[seen, p], col) for p, basis in enumerate(s) for col in basis.T])
    cov = phi @ phi.T + np.eye(len(r)) / lam[i]
    return -0.5 * (r @ np.linalg.solve(cov, r) + np.linalg.slogdet(cov)[1] + len(r) * np.log(2 * np.pi))


def point(seed=1, ranks=(2, 1)):
    x, y = sample(seed)
    rng = np.random.default_rng(seed + 1)
    s = [rng.standard_normal((4, r)) for r in ranks]
    return x, y, from_arrays(y, x), s, rng.uniform(0.5, 2, 6), rng.standard_normal((6, 4))


@pytest.mark.parametrize("ranks", [(2, 1), (0, 1), (4, 4)])
def test_marginal_likelihood_is_the_dense_one(ranks):
    x, y, m, s, lam, b = point(ranks=ranks)
    assert marginal_log_likelihood(s, lam, b, m) == pytest.approx(sum(dense(x, y, s, lam, b, i) for i in range(6)), rel=1e-10)


def test_gradients_are_differences():
    _, _, m, s, lam, b = point()
    _, gs, gl = marginal_gradients(s, lam, b, m)
    f = lambda s, lam: -marginal_log_likelihood(s, lam, b, m)
    e = 1e-6
    for p in (0, 1):
        for at in np.ndindex(s[p].shape):
            up, down = [v.copy() for v in s], [v.copy() for v in s]
            up[p][at] += e
            down[p][at] -= e
            assert gs[p][at] == pytest.approx((f(up, lam) - f(down, lam)) / (2 * e), rel=1e-5, abs=1e-6)
    for i in range(6):
        d = np.eye(6)[i] * e
        assert gl[i] == pytest.approx((f(s, lam + d) - f(s, lam - d)) / (2 * e), rel=1e-5, abs=1e-6)


def test_intercept_step_is_stationary():
    _, _, m, s, lam, _ = point()
    b = update_intercept(s, lam, m)
    best = marginal_log_likelihood(s, lam, b, m)
    rng = np.random.default_rng(3)
    for _ in range(10):
        assert marginal_log_likelihood(s, lam, b + 1e-3 * rng.standard_normal(b.shape), m) < best


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_ecme_never_raises_the_objective(seed):
    _, _, m, s, lam, b = point(seed)
    trace = ecme(m, s, lam, b, max_iter=8, tol=1e-12).trace
    assert all(b <= a + 1e-9 * abs(a) for a, b in zip(trace, trace[1:]))


def test_refinement_improves_and_is_stationary():
    _, _, m, _, _, _ = point(5)
    cold = fit_marginal(m, [2, 1], refine_max_iter=1)
    fit = fit_marginal(m, [2, 1], refine_max_iter=60, refine_tol=1e-9)
    assert fit.log_likelihood >= cold.log_likelihood - 1e-8
    _, gs, gl = marginal_gradients(fit.bases, fit.precision, fit.intercept, m)
    assert max(np.abs(g).max() for g in gs) < 0.05 and np.abs(gl * fit.precision).max() < 1e-2
    mu, cov = posterior_weights(fit.bases, fit.precision, fit.intercept, m)
    assert mu[0].shape == (6, 2) and cov.shape == (6, 3, 3)


def test_counts_and_aic():
    assert criteria.count_least_squares([2, 1], 10, 5, formula="reference") == 296
    assert criteria.count_marginal([3, 4, 2], 100, 15, formula="reference") == 1735
    assert criteria.aic(-10.0, 3) == 26.0
    with pytest.raises(ParameterError):
        criteria.count_marginal([9], 4, 4)


def test_greedy_search_finds_the_bowl():
    best, history = greedy_search(lambda r: r, lambda f, r: (r[0] - 3) ** 2 + (r[1] - 2) ** 2, [1, 1], 5, names=("a", "b"))
    assert best == (3, 2) and history.final_ranks == {"a": 3, "b": 2} and history.accepted[-1] is None


def test_recovers_ranks_and_coefficients():
    truth = draw_truth(n_neurons=60, n_bins=8, n_trials=300, ranks=(2, 1), noise_precision=2.0, seed=1)
    rng = np.random.default_rng(2)
    y = truth.intercept + np.einsum("kp,pnt->knt", truth.x, np.stack(truth.coefficients)) + rng.standard_normal((300, 60, 8)) / np.sqrt(2)
    y[rng.random((300, 60)) < 0.2] = np.nan
    m = from_arrays(y, truth.x)
    for estimator in ("svd", "mmle"):
        model = LowRankRegression(estimator=estimator, max_rank=4).fit_moments(m)
        assert model.ranks_ == {"x0": 2, "x1": 1}
        for k, b in zip(model.names_, truth.coefficients, strict=True):
            assert np.corrcoef(model.B_[k].ravel(), b.ravel())[0, 1] > 0.97


def test_subspaces():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((9, 2)), rng.standard_normal((9, 2))
    out = subspaces.orthogonalize({"a": a, "b": np.column_stack((b, a[:, 0]))}, ["a", "b"])
    q = np.column_stack((out["a"], out["b"]))
    assert out["b"].shape[1] == 2 and np.allclose(q.T @ q, np.eye(4))
    assert np.allclose(subspaces.subspace_angles(a, a @ rng.standard_normal((2, 2))), 0, atol=1e-10)
    tiny = subspaces.subspace_angles(np.eye(3)[:, :1], np.array([[1.0], [1e-9], [0]]))
    assert tiny[0] == pytest.approx(1e-9, rel=1e-6)
    w, s = subspaces.canonical_factors(a @ b.T)
    assert np.allclose(w @ s.T, a @ b.T) and np.allclose(w.T @ w, np.eye(2))


def test_minimize_rosenbrock():
    f = lambda x: ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    found = minimize(f, np.array([-1.2, 1.0]), progress=1e-14)
    assert np.allclose(found.x, 1, atol=1e-4)


def test_degenerate_neurons_are_rejected():
    x, y = sample()
    y[:, 1] = 0.0
    with pytest.raises(ValidationError):
        fit_least_squares(from_arrays(y, x))


def test_parameters_roll_back():
    model = LowRankRegression()
    with pytest.raises(ParameterError):
        model.set_params(ridge=-1)
    assert model.ridge == 0.0
    with pytest.raises(AttributeError):
        model.B_


def test_deficient_least_squares_is_least_norm_at_unequal_scales():
    r = np.random.default_rng(8)
    a = r.standard_normal((40, 2))
    x = np.column_stack((a[:, 0], 10 * a[:, 0], a[:, 1], np.zeros(40), a[:, 0] - 3 * a[:, 1]))
    y = r.standard_normal((40, 4))
    beta, short = kernels.solve_least_squares((x.T @ x)[None], (x.T @ y)[None])
    assert short.all() and np.allclose(beta[0], np.linalg.lstsq(x, y, rcond=1e-10)[0], atol=1e-8)


def test_moments_of_arrays_equal_sums_over_observed_trials():
    r = np.random.default_rng(9)
    y, x = r.standard_normal((30, 21, 3)) + 1e3, r.standard_normal((30, 2)) + 50
    y[r.random((30, 21)) < 0.4] = np.nan
    y[:, 5] = np.nan
    m = from_arrays(y, x)
    for k in range(21):
        own = ~np.isnan(y[:, k, 0])
        assert m.n[k] == own.sum()
        if not own.any():
            assert np.isnan(m.x_mean[k]).all() and np.isnan(m.y_mean[k]).all() and not m.xtx[k].any() and not m.xty[k].any() and m.yty[k] == 0
            continue
        xc, yc = x[own] - x[own].mean(axis=0), y[own, k] - y[own, k].mean(axis=0)
        for got, want in ((m.x_mean[k], x[own].mean(axis=0)), (m.y_mean[k], y[own, k].mean(axis=0)), (m.xtx[k], xc.T @ xc), (m.xty[k], xc.T @ yc), (m.yty[k], (yc**2).sum())):
            assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
