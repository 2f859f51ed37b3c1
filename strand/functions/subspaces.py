"""Canonical factors, ordered orthogonalisation and principal angles."""

from __future__ import annotations

import numpy as np

from .kernels import signed_svd

ROOT_EPS = float(np.sqrt(np.finfo(float).eps))


def canonical_factors(b: np.ndarray, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(W, S) with W orthonormal and W S^T = b truncated; the rank defaults to the numerical one."""
    b = np.asarray(b, dtype=float)
    if rank is None:
        s = np.linalg.svd(b, compute_uv=False)
        rank = int((s > s.max(initial=0.0) * max(b.shape) * np.finfo(float).eps).sum())
    u, s, v = signed_svd(b, rank)
    return u, v * s


def orthogonalize(weights: dict[str, np.ndarray], order: list[str]) -> dict[str, np.ndarray]:
    """An orthonormal basis per regressor, each orthogonal to those before it; directions already spanned are dropped."""
    done, out = None, {}
    for name in order:
        kept = []
        for column in np.asarray(weights[name], dtype=float).T:
            size, v = np.linalg.norm(column), column.copy()
            for _ in range(2):
                for basis in ([] if done is None else [done]) + ([np.column_stack(kept)] if kept else []):
                    v = v - basis @ (basis.T @ v)
            if size > 0 and np.linalg.norm(v) > ROOT_EPS * size:
                kept.append(v / np.linalg.norm(v))
        out[name] = np.column_stack(kept) if kept else np.empty((len(weights[name]), 0))
        done = out[name] if done is None else np.column_stack((done, out[name]))
    return out


def _span(m: np.ndarray) -> np.ndarray:
    u, s, _ = np.linalg.svd(np.asarray(m, dtype=float), full_matrices=False)
    return u[:, s > s.max(initial=0.0) * max(m.shape) * np.finfo(float).eps]


def subspace_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Principal angles, ascending: cosines for large angles, sines for small ones."""
    qa, qb = _span(a), _span(b)
    if qa.shape[1] < qb.shape[1]:
        qa, qb = qb, qa
    cos = np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), 0, 1)
    sin = np.clip(np.linalg.svd(qb - qa @ (qa.T @ qb), compute_uv=False)[::-1], 0, 1)
    return np.sort(np.where(cos**2 > 0.5, np.arcsin(sin), np.arccos(cos)))
