"""Errors and warnings."""

from __future__ import annotations

import numpy as np


class StrandError(Exception):
    """Root of the errors raised here."""


class ValidationError(StrandError, ValueError):
    """Data that can't be used."""


class ParameterError(StrandError, ValueError):
    """An argument out of its range."""


class SingularDesignError(StrandError, np.linalg.LinAlgError):
    """Regressors that don't determine the coefficients."""


class NotFittedError(StrandError, AttributeError):
    """A fitted quantity asked for before fit."""


class StrandWarning(UserWarning):
    """Root of the warnings given here."""


class ConvergenceWarning(StrandWarning):
    """An iteration that stopped at its cap."""


class DesignWarning(StrandWarning):
    """Regressors that are usable but badly placed."""


class DecodingWarning(StrandWarning):
    """Trials without a decoded value."""


class ProjectionWarning(StrandWarning):
    """Trials without a projection."""


#: Offenders that a message lists.
LISTED = 20


def listed(items) -> str:
    items = list(items)
    more = f" and {len(items) - LISTED} more" if len(items) > LISTED else ""
    return ", ".join(map(str, items[:LISTED])) + more
