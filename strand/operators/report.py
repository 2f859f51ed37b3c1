"""Fits as long tables, and the numbers behind the usual plots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit_frames(spark: SparkSession, model) -> dict[str, DataFrame]:
    """coef(regressor, neuron_id, b, w), bases(regressor, bin, s), neuron_params, summary; write each as Parquet."""
    coef, bases = [], []
    for name in model.names_:
        for k, i in enumerate(model.neuron_ids_):
            coef.append((name, int(i), model.B_[name][k].tolist(), model.W_[name][k].tolist()))
        bases += [(name, t, row.tolist()) for t, row in enumerate(model.S_[name])]
    neurons = [(int(i), model.intercept_[k].tolist(), float(model.noise_precision_[k]), int(model.n_obs_[k])) for k, i in enumerate(model.neuron_ids_)]
    summary = [(float(model.log_likelihood_), int(model.n_parameters_), float(model.aic_), bool(model.converged_), {k: int(v) for k, v in model.ranks_.items()})]
    return {
        "coef": spark.createDataFrame(coef, "regressor string, neuron_id long, b array<double>, w array<double>"),
        "bases": spark.createDataFrame(bases, "regressor string, bin int, s array<double>"),
        "neuron_params": spark.createDataFrame(neurons, "neuron_id long, intercept array<double>, noise_precision double, n_obs long"),
        "summary": spark.createDataFrame(summary, "log_likelihood double, n_parameters long, aic double, converged boolean, ranks map<string,int>"),
    }


def history_frame(spark: SparkSession, history) -> DataFrame:
    return spark.createDataFrame(history.rows(), "step int, ranks map<string,int>, aic double, converged boolean, candidates map<string,double>, accepted string")


def bases_frame(spark: SparkSession, model) -> DataFrame:
    """(regressor, component, bin, value, singular_value, share of the squared norm)."""
    out = []
    for name in model.names_:
        s = model.S_[name]
        sizes = np.linalg.norm(s, axis=0) * np.linalg.norm(model.W_[name], axis=0)
        total = float((model.B_[name] ** 2).sum()) or 1.0
        out += [(name, j, t, float(s[t, j]), float(sizes[j]), float(sizes[j] ** 2 / total)) for j in range(s.shape[1]) for t in range(len(s))]
    return spark.createDataFrame(out, "regressor string, component int, bin int, value double, singular_value double, share double")


def weights_histogram(weights: DataFrame, component: int = 0, buckets: int = 20) -> DataFrame:
    """(bucket, low, high, n) of one component of weights(neuron_id, w array)."""
    v = weights.select(F.get("w", F.lit(component)).alias("v"))
    edge = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    width = (edge["hi"] - edge["lo"]) / buckets or 1.0
    at = F.least(F.floor((F.col("v") - edge["lo"]) / width), F.lit(buckets - 1)).cast("int")
    counts = v.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.select("bucket", (edge["lo"] + F.col("bucket") * width).alias("low"), (edge["lo"] + (F.col("bucket") + 1) * width).alias("high"), "n")


def recovery(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(regressor, correlation) between two coef(regressor, neuron_id, b array) frames."""
    a = estimate.select("regressor", "neuron_id", F.posexplode("b").alias("bin", "a"))
    b = truth.select("regressor", "neuron_id", F.posexplode("b").alias("bin", "b"))
    return a.join(b, ["regressor", "neuron_id", "bin"]).groupBy("regressor").agg(F.corr("a", "b").alias("correlation"))
