"""Frames of the regression model, their checks, and the mask that missing values imply.

obs(trial_id, neuron_id, y array<double>) has one row per observed neuron-trial: an
unobserved one has no row. design(trial_id, x array<double>) has one row per trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LISTED, ValidationError, listed

NUMERIC = (T.BooleanType, T.NumericType)
#: Rows of a design that is broadcast, after counting.
BROADCAST_TRIALS = 500_000


def as_vector(df: DataFrame, column: str) -> Column:
    """column as array<double>; ValidationError unless it is an array of numbers."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, NUMERIC):
        raise ValidationError(f"{column} must be an array of numbers, not {kind.simpleString()}; code categories as numbers first")
    return F.col(column).cast("array<double>").alias(column)


def has_nan(column: str) -> Column:
    return F.exists(column, lambda v: v.isNull() | F.isnan(v))


def has_inf(column: str) -> Column:
    return F.exists(column, lambda v: F.abs(v) == float("inf"))


def one_width(df: DataFrame, column: str) -> int:
    row = df.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if row["a"] is None:
        raise ValidationError(f"{column} has no rows")
    if row["a"] != row["b"] or row["a"] < 1:
        raise ValidationError(f"{column} must have one length, at least 1, in every row; got {row['a']} to {row['b']}")
    return row["a"]


def observed(rows: DataFrame, mask: str | None = None) -> DataFrame:
    """obs from rows (trial_id, neuron_id, y [, mask]).

    Without a mask a neuron-trial with any NaN or null bin is unobserved, its other bins
    included; infinities are errors. With one, rows under false are dropped whatever they
    hold, and rows under true must be finite.
    """
    rows = rows.withColumn("y", as_vector(rows, "y"))
    if mask is None:
        kept = rows.where(F.col("y").isNotNull() & ~has_nan("y"))
        bad = rows.where(F.col("y").isNotNull() & has_inf("y"))
        what = "infinite responses"
    else:
        if not isinstance(rows.schema[mask].dataType, T.BooleanType):
            odd = rows.where(~F.col(mask).cast("double").isin(0.0, 1.0) | F.col(mask).isNull()).limit(1).count()
            if odd:
                raise ValidationError("the mask must be boolean or exactly 0 or 1")
        kept = rows.where(F.col(mask).cast("boolean"))
        bad = kept.where(F.col("y").isNull() | has_nan("y") | has_inf("y"))
        what = "non-finite responses under a true mask"
    found = bad.select("trial_id", "neuron_id").limit(LISTED + 1).collect()
    if found:
        raise ValidationError(f"{what} at (trial, neuron) {listed((r[0], r[1]) for r in found)}")
    return kept.select("trial_id", "neuron_id", "y")


def checked_design(design: DataFrame) -> DataFrame:
    design = design.select("trial_id", as_vector(design, "x"))
    bad = design.where(F.col("x").isNull() | has_nan("x") | has_inf("x")).select("trial_id").limit(LISTED + 1).collect()
    if bad:
        raise ValidationError(f"the design must be finite; trials {listed(r[0] for r in bad)}")
    one_width(design, "x")
    return design


def observation_floor(min_observations: int, estimator: str, n_regressors: int, intercept: bool) -> int:
    return max(min_observations, n_regressors + 1 + int(intercept)) if estimator == "mmle" else min_observations


def fit_checks(obs: DataFrame, neurons: DataFrame, floor: int) -> None:
    """Neurons with too few trials, then neurons whose responses never vary."""
    per = obs.groupBy("neuron_id").agg(F.count("*").alias("n"), F.min(F.array_min("y")).alias("lo"), F.max(F.array_max("y")).alias("hi"))
    per = neurons.select("neuron_id").join(per, "neuron_id", "left")
    few = per.where(F.coalesce("n", F.lit(0)) < floor).select("neuron_id").orderBy("neuron_id").limit(LISTED + 1).collect()
    if few:
        raise ValidationError(f"neurons observed on fewer than {floor} trials: {listed(r[0] for r in few)}")
    flat = per.where(F.col("lo") == F.col("hi")).select("neuron_id").orderBy("neuron_id").limit(LISTED + 1).collect()
    if flat:
        raise ValidationError(f"neurons whose responses are constant: {listed(r[0] for r in flat)}")


def with_design(obs: DataFrame, design: DataFrame) -> DataFrame:
    """obs with each trial's x; the design is broadcast only if it is small."""
    side = F.broadcast(design) if design.limit(BROADCAST_TRIALS + 1).count() <= BROADCAST_TRIALS else design
    return obs.join(side, "trial_id")
