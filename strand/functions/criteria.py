"""Parameter counts and Akaike's criterion."""

from __future__ import annotations

import math

from ..errors import ParameterError


def _checked(ranks, n_neurons: int, n_bins: int) -> list[int]:
    ranks = [int(r) for r in ranks]
    if n_neurons < 1 or n_bins < 1 or any(r < 0 or r > min(n_neurons, n_bins) for r in ranks):
        raise ParameterError("ranks lie between 0 and the smaller of neurons and bins")
    return ranks


def count_least_squares(ranks, n_neurons: int, n_bins: int, *, condition_independent: bool = True, formula: str = "textbook") -> int:
    """Degrees of freedom of low-rank matrices, noise and intercept; "reference": the rank-sum formula with the intercept as a full-rank term."""
    r = _checked(ranks, n_neurons, n_bins)
    if formula == "textbook":
        return sum(k * (n_neurons + n_bins - k) for k in r) + n_neurons + (n_neurons * n_bins if condition_independent else 0)
    if formula == "reference":
        terms = r + [min(n_neurons, n_bins)] * bool(condition_independent)
        return (n_neurons * len(terms) + n_bins * len(terms) - sum(terms)) * sum(terms)
    raise ParameterError(f"unknown formula {formula!r}")


def count_marginal(ranks, n_neurons: int, n_bins: int, *, condition_independent: bool = True, formula: str = "identifiable") -> int:
    """Bases, noise and intercept; "identifiable" leaves out each basis's rotations."""
    r = _checked(ranks, n_neurons, n_bins)
    if formula not in ("identifiable", "reference"):
        raise ParameterError(f"unknown formula {formula!r}")
    rotations = sum(k * (k - 1) // 2 for k in r) if formula == "identifiable" else 0
    return n_neurons + n_bins * sum(r) - rotations + (n_neurons * n_bins if condition_independent else 0)


def aic(log_likelihood: float, n_parameters: int) -> float:
    if math.isnan(log_likelihood):
        raise ParameterError("the log-likelihood is NaN")
    return 2.0 * n_parameters - 2.0 * log_likelihood
