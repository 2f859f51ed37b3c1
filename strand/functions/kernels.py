"""Batched dense algebra on moments, one matrix per neuron; shared by driver and executors."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from ..operators.moments import Moments

#: Eigenvalues of unit-diagonal Gram matrices up to this count as zero.
RANK_TOLERANCE = 1e-10
#: Residuals up to this many roundings of the energy count as zero.
ROUNDING = 1e3


def solve_least_squares(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, whether the Gram matrix is deficient); of a deficient one's solutions, that of least norm.

    Rank is judged at unit diagonal; what lies in the null space is then taken off in the regressors' own units.
    """
    scale = np.sqrt(np.maximum(np.einsum("npp->np", gram), 0))
    inv = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    values, vectors = np.linalg.eigh(gram * inv[:, :, None] * inv[:, None, :])
    keep = values > RANK_TOLERANCE
    back = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
    z = np.einsum("npk,npt->nkt", vectors, rhs * inv[:, :, None])
    beta = np.einsum("npk,nkt->npt", vectors, back[:, :, None] * z) * inv[:, :, None]
    short = ~keep.all(axis=1)
    if short.any():
        null = inv[short][:, :, None] * vectors[short] * ~keep[short][:, None, :]
        size = np.linalg.norm(null, axis=1, keepdims=True)
        null = np.divide(null, size, out=np.zeros_like(null), where=size > 0)
        beta[short] -= null @ (np.linalg.pinv(null, rcond=RANK_TOLERANCE) @ beta[short])
    return beta, short


def normal_equations(m: Moments, intercept: bool, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    n, p, _ = m.shape
    eye = ridge * np.eye(p)
    if not intercept:
        xtx, xty, _ = m.raw()
        return xtx + eye, xty
    x, y = np.nan_to_num(m.x_mean), np.nan_to_num(m.y_mean)
    c = m.n * ridge / np.maximum(m.n + ridge, 1e-300)
    return m.xtx + eye + c[:, None, None] * x[:, :, None] * x[:, None, :], m.xty + c[:, None, None] * x[:, :, None] * y[:, None, :]


def residual(xtx: np.ndarray, xty: np.ndarray, yty: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return yty - 2 * np.einsum("npt,npt->n", beta, xty) + np.einsum("npt,npq,nqt->n", beta, xtx, beta)


class Blocks(NamedTuple):
    """Bases side by side (bins, components) and each component's regressor."""

    s: np.ndarray
    of: np.ndarray


def blocks(bases: list[np.ndarray]) -> Blocks:
    return Blocks(np.concatenate(bases, axis=1), np.repeat(np.arange(len(bases)), [b.shape[1] for b in bases]))


def split(matrix: np.ndarray, b: Blocks, n_regressors: int) -> list[np.ndarray]:
    return [matrix[..., b.of == p] for p in range(n_regressors)]


class State(NamedTuple):
    """Everything the marginal likelihood needs at one point, per neuron."""

    k: np.ndarray
    u: np.ndarray
    mu: np.ndarray
    cov: np.ndarray
    quad: np.ndarray
    logdet: np.ndarray


def posterior(lam: np.ndarray, k: np.ndarray, u: np.ndarray) -> State:
    """Weights' posterior from K and u: C = I + lam K, mean lam C^-1 u, covariance C^-1."""
    r = k.shape[-1]
    chol = np.linalg.cholesky(np.eye(r) + lam[:, None, None] * k)
    half = np.linalg.inv(chol) if r else chol
    white = np.einsum("nij,nj->ni", half, lam[:, None] * u)
    cov = np.einsum("nki,nkj->nij", half, half)
    mu = np.einsum("nki,nk->ni", half, white)
    logdet = 2 * np.log(np.einsum("nii->ni", chol)).sum(axis=1)
    return State(k, u, mu, cov, (white * white).sum(axis=1), logdet)


def state(b: Blocks, lam: np.ndarray, xtx: np.ndarray, xty: np.ndarray) -> State:
    k = xtx[:, b.of][:, :, b.of] * (b.s.T @ b.s)
    return posterior(lam, k, np.einsum("tk,nkt->nk", b.s, xty[:, b.of]))


def nll_terms(st: State, lam: np.ndarray, yty: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Each neuron's negative log marginal likelihood, constants included."""
    return 0.5 * (-n * bins * (np.log(lam) - np.log(2 * np.pi)) + st.logdet + lam * yty - st.quad)


def second_moment(st: State) -> np.ndarray:
    return st.mu[:, :, None] * st.mu[:, None, :] + st.cov


def expected_residual(st: State, yty: np.ndarray) -> np.ndarray:
    return yty - 2 * (st.u * st.mu).sum(axis=1) + np.einsum("nij,nji->n", st.k, second_moment(st))


def basis_sums(b: Blocks, st: State, lam: np.ndarray, xtx: np.ndarray, xty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over neurons that the basis step and gradient need: (components, components) and (bins, components)."""
    h = np.einsum("n,nij,nij->ij", lam, xtx[:, b.of][:, :, b.of], second_moment(st))
    return h, np.einsum("n,nk,nkt->tk", lam, st.mu, xty[:, b.of])


def intercepts(b: Blocks, lam: np.ndarray, m: Moments) -> np.ndarray:
    """The best intercept of each neuron and bin, in closed form."""
    st = state(b, lam, m.xtx, m.xty)
    return np.nan_to_num(m.y_mean) - np.einsum("nk,nk,tk->nt", np.nan_to_num(m.x_mean)[:, b.of], st.mu, b.s)


def precision_gradient(st: State, lam: np.ndarray, yty: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    return 0.5 * (expected_residual(st, yty) - n * bins / lam)


def precision_newton(k, u, yty, n, bins: int, lam: np.ndarray, rounds: int = 60, box: float = 23.0, tolerance: float = 1e-10):
    """Each neuron's best precision by safeguarded Newton steps on its logarithm, from one eigendecomposition."""
    values, vectors = np.linalg.eigh(k)
    values = np.maximum(values, 0)
    z2 = np.einsum("nij,ni->nj", vectors, u) ** 2
    theta = np.log(lam)
    low, high = theta - box, theta + box
    counts = n * bins

    def at(t):
        e = np.exp(t)[:, None]
        c = 1 + e * values
        value = 0.5 * (-counts * t + np.log(c).sum(axis=1) + e[:, 0] * yty - (e * e * z2 / c).sum(axis=1))
        g = 0.5 * (-counts + (e * values / c).sum(axis=1) + e[:, 0] * yty - (e * e * z2 * (2 + e * values) / c**2).sum(axis=1))
        return value, g

    value, g = at(theta)
    for _ in range(rounds):
        step = 1e-5
        h = (at(theta + step)[1] - at(theta - step)[1]) / (2 * step)
        move = np.clip(np.where(h > 0, -g / np.where(h > 0, h, 1), -np.sign(g)), -2, 2)
        for _ in range(30):
            trial = np.clip(theta + move, low, high)
            new, ng = at(trial)
            worse = new > value + 1e-12 * np.abs(value)
            if not worse.any():
                break
            move = np.where(worse, move / 2, move)
        better = ~(new > value + 1e-12 * np.abs(value))
        theta, value, g = np.where(better, trial, theta), np.where(better, new, value), np.where(better, ng, g)
        if (np.abs(g) <= tolerance * counts).all():
            break
    return np.exp(theta), np.abs(g) <= 1e-8 * np.maximum(counts, 1)


def signed_svd(matrix: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading singular triplets; the largest entry of each left vector is positive, the first among equals."""
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    u, s, v = u[:, :rank], s[:rank], vt[:rank].T
    if u.size:
        sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
        sign[sign == 0] = 1
        u, v = u * sign, v * sign
    return u, s, v
