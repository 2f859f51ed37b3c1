"""Greedy rank search and its history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..errors import ParameterError

NEAR_TIE = 2.0


@dataclass(frozen=True)
class SearchHistory:
    names: tuple[str, ...]
    ranks: tuple[tuple[int, ...], ...]
    aic: tuple[float, ...]
    converged: tuple[bool, ...]
    candidates: tuple[dict[int, float], ...]
    accepted: tuple[int | None, ...]
    seed: "SearchHistory | None" = None

    @property
    def final_ranks(self) -> dict[str, int]:
        return dict(zip(self.names, self.ranks[-1], strict=True))

    @property
    def n_fits(self) -> int:
        return 1 + sum(map(len, self.candidates))

    def margins(self) -> list[dict[str, float | None]]:
        """Per round: the best improvement, its distance to the threshold's zero, and to the runner-up."""
        out = []
        for before, scores in zip(self.aic, self.candidates, strict=False):
            order = sorted(scores.values())
            best = before - order[0] if order else None
            out.append({"improvement": best, "decision": None if best is None else abs(best), "runner_up": order[1] - order[0] if len(order) > 1 else None})
        return out

    def near_ties(self, within: float = NEAR_TIE) -> list[str]:
        lines = []
        for k, m in enumerate(self.margins()):
            for what in ("decision", "runner_up"):
                if m[what] is not None and m[what] < within:
                    lines.append(f"round {k + 1}: {what.replace('_', '-')} within {m[what]:.3g} AIC units")
        return lines

    def rows(self) -> list[dict]:
        out = []
        for k, ranks in enumerate(self.ranks):
            scores = self.candidates[k] if k < len(self.candidates) else {}
            took = self.accepted[k] if k < len(self.accepted) else None
            out.append(
                {
                    "step": k,
                    "ranks": dict(zip(self.names, ranks, strict=True)),
                    "aic": self.aic[k],
                    "converged": self.converged[k],
                    "candidates": {self.names[j]: s for j, s in scores.items()},
                    "accepted": None if took is None else self.names[took],
                }
            )
        return out


def greedy_search(fit: Callable, objective: Callable, init_ranks, max_rank: int, threshold: float = 0.0, names=None, fit_many: Callable | None = None, callback: Callable | None = None):
    """(best fit, history): raise by one the rank that lowers the objective most, while it drops by more than threshold.

    fit(ranks) -> fit; objective(fit, ranks) -> score; fit_many(list of ranks) -> fits
    evaluates a round at once; callback(step, ranks, score) is told what was accepted.
    """
    ranks = tuple(int(r) for r in init_ranks)
    if not ranks or any(r < 0 or r > max_rank for r in ranks):
        raise ParameterError(f"initial ranks lie between 0 and {max_rank}")
    names = tuple(names or (f"x{i}" for i in range(len(ranks))))
    many = fit_many or (lambda all_ranks: [fit(r) for r in all_ranks])
    best = fit(ranks)
    score = float(objective(best, ranks))
    steps, scores, converged = [ranks], [score], [bool(getattr(best, "converged", True))]
    rounds, accepted = [], []
    while True:
        movable = [j for j in range(len(ranks)) if ranks[j] < max_rank]
        trials = [tuple(r + (i == j) for i, r in enumerate(ranks)) for j in movable]
        fits = many(trials) if trials else []
        found = {j: float(objective(f, r)) for j, f, r in zip(movable, fits, trials, strict=True)}
        if any(v != v for v in found.values()):
            raise ParameterError("the objective returned NaN")
        rounds.append(found)
        top = min(found, key=lambda j: (found[j], j), default=None)
        if top is None or not scores[-1] - found[top] > threshold:
            accepted.append(None)
            break
        at = movable.index(top)
        ranks, best = trials[at], fits[at]
        steps.append(ranks)
        scores.append(found[top])
        converged.append(bool(getattr(best, "converged", True)))
        accepted.append(top)
        if callback:
            callback(len(steps) - 1, ranks, found[top])
    return best, SearchHistory(names, tuple(steps), tuple(scores), tuple(converged), tuple(rounds), tuple(accepted))
