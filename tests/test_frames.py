"""Frames against the dense path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strand.errors import DesignWarning, ParameterError, ProjectionWarning, ValidationError
from strand.operators import evaluate, prepare
from strand.operators.moments import collected, from_arrays, moments
from strand.plans.distributed import candidate_fits
from strand.plans.estimator import LowRankRegression
from strand.plans.fit import fit_least_squares
from strand.sources import frames
from tests.test_kernels import sample


def rows_of(spark, y):
    data = [(k, i, [float(v) for v in y[k, i]]) for k in range(y.shape[0]) for i in range(y.shape[1])]
    return spark.createDataFrame(data, "trial_id long, neuron_id long, y array<double>")


def design_of(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "trial_id long, x array<double>")


def test_moments_and_fit(spark):
    x, y = sample(base=1e5)
    m = collected(moments(frames.observed(rows_of(spark, y)), design_of(spark, x)))
    want = from_arrays(y, x)
    for name in ("n", "x_mean", "y_mean", "xtx", "xty", "yty"):
        np.testing.assert_allclose(getattr(m, name), getattr(want, name), rtol=1e-8)
    model = LowRankRegression(ranks=[1, 2], estimator="svd").fit(rows_of(spark, y), design_of(spark, x))
    dense = fit_least_squares(want, [1, 2])
    np.testing.assert_allclose(model.B_["x1"], dense.coefficients[1], atol=1e-7)
    fits = candidate_fits(spark, want, [(1, 1), (1, 2)], "svd")
    np.testing.assert_allclose(fits[1].precision, dense.precision, rtol=1e-12)


def test_masks(spark):
    y = np.ones((2, 2, 2)) * np.arange(8).reshape(2, 2, 2)
    y[0, 1, 0] = np.nan
    assert frames.observed(rows_of(spark, y)).count() == 3
    y[1, 1, 1] = np.inf
    with pytest.raises(ValidationError):
        frames.observed(rows_of(spark, y))
    masked = rows_of(spark, y).withColumn("mask", F.col("neuron_id") == 0)
    assert frames.observed(masked, "mask").count() == 2
    with pytest.raises(ValidationError):
        frames.observed(masked.withColumn("mask", F.lit(2)), "mask")


def test_project_decode_and_scores(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack((rng.standard_normal(30), rng.choice([-1.0, 1.0], 30)))
    b = rng.standard_normal((2, 5, 3))
    y = np.einsum("kp,pnt->knt", x, b) + 1e-4 * rng.standard_normal((30, 5, 3))
    y[0] = np.nan
    rows, design = rows_of(spark, y), design_of(spark, x)
    model = LowRankRegression(ranks=[3, 3], estimator="svd").fit(rows, design)
    out = {r["trial_id"]: r for r in model.decode(rows, ["x0", "x1"], levels={"x1": [-1.0, 1.0]}).collect()}
    assert len(out) == 30 and np.isnan([*out[0]["values"], *out[0]["profile"], out[0]["log_likelihood"], out[0]["llr"]]).all()
    for k, r in out.items():
        if k == 0:
            continue
        np.testing.assert_allclose(r["values"], x[k], atol=1e-2)
        assert (r["llr"] > 0) == (x[k, 1] > 0)
    z = {r["trial_id"]: np.array(r["z"]).reshape(3, -1) for r in model.project(rows, "x0").collect()}
    w = model.W_["x0"]
    d = np.sqrt(model.noise_precision_)[:, None]
    want = np.linalg.lstsq(d * w, d * (y[4] - model.intercept_), rcond=None)[0].T
    np.testing.assert_allclose(z[4], want, atol=1e-8)
    assert len(z) == 30 and z[0].shape == z[4].shape and np.isnan(z[0]).all()
    paper = {r["trial_id"]: np.array(r["z"]).reshape(3, -1) for r in model.project(rows, "x0", method="paper", remove_intercept=False).collect()}
    np.testing.assert_allclose(paper[4], (w.T @ y[4]).T, atol=1e-8)
    assert (paper[0] == 0).all()
    few = {r["trial_id"]: np.array(r["z"]) for r in model.project(rows.where("neuron_id < 2"), "x0").collect()}
    assert np.isnan(few[4]).all()  # two neurons, three components
    with pytest.warns(ProjectionWarning, match=": 0"):
        model.project(rows, "x0")
    with pytest.raises(ValidationError, match="fitted ones: 5"):
        model.project(rows.withColumn("neuron_id", F.col("neuron_id") + 1), "x0")
    with pytest.raises(ValidationError, match="3 bins"):
        model.score(rows.withColumn("y", F.slice("y", 1, 2)), design)
    with pytest.raises(ValidationError, match="design row: 7"):
        model.score(rows, design.where("trial_id <> 7"))
    with pytest.raises(ValidationError, match="2 columns"):
        model.predict(design.withColumn("x", F.slice("x", 1, 1)))
    ev = {r["term"]: r["explained"] for r in model.explained_variance(rows, design).collect()}
    assert ev["total"] > 0.999
    per = {r["trial_id"]: r["log_likelihood"] for r in model.log_likelihood(rows, design, per_trial=True).collect()}
    assert np.isnan(per[0]) and model.score(rows, design) == pytest.approx(sum(v for k, v in per.items() if k))


def test_conditions_and_split(spark):
    y = np.arange(4.0).reshape(4, 1, 1)
    x = np.array([[1.0], [-1.0], [1.0], [-1.0]])
    avg, xs, conds = prepare.condition_average(frames.observed(rows_of(spark, y)), design_of(spark, x), rows_of(spark, y))
    assert {r["cond_id"]: r["y"] for r in avg.collect()} == {0: [2.0], 1: [1.0]}
    assert [r["cond_id"] for r in conds.orderBy("trial_id").collect()] == [1, 0, 1, 0]
    trials = spark.range(50).select(F.col("id").alias("trial_id"), (F.col("id") % 3).alias("s"))
    sizes = {r["s"]: r["n"] for r in prepare.split_trials(trials, 0.3, 1, "s").groupBy("s").agg(F.count_if("test").alias("n")).collect()}
    assert sizes == {0: 5, 1: 5, 2: 5}


def test_design_report(spark):
    x = np.random.default_rng(0).standard_normal((30, 2))
    ok = prepare.check_design(design_of(spark, x))
    assert not ok.problems and ok.rank == 2 and ok.augmented_rank == 3
    assert ok.condition_number == pytest.approx(np.linalg.cond(x / np.linalg.norm(x, axis=0)), rel=1e-6)
    bad = prepare.check_design(design_of(spark, np.column_stack((x, np.ones(30), x[:, 0]))))
    assert bad.rank == 3 and len(bad.problems) == 2 and bad.max_abs_correlation == pytest.approx(1)


def test_design_report_by_neuron(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack((rng.standard_normal(12), rng.choice([-1.0, 1.0], 12), rng.standard_normal(12)))
    x[:, 2] = 3 * x[:, 0]
    y = rng.standard_normal((12, 6, 2))
    y[5] = np.nan  # a trial without observations
    y[3:, 1] = np.nan  # three trials
    y[x[:, 1] < 0, 2] = np.nan  # a regressor constant over its trials
    y[:, 3] = np.nan  # never observed
    rows, design = rows_of(spark, y), design_of(spark, x[:, :2])
    obs, neurons = frames.observed(rows), rows.select("neuron_id")
    r = prepare.check_design(design, obs, estimator="mmle", neurons=neurons)
    seen = ~np.isnan(y[:, :, 0])
    centred = lambda i: x[seen[:, i], :2] - x[seen[:, i], :2].mean(axis=0)
    ids = lambda df, c: sorted(v[0] for v in df.select(c).collect())
    assert ids(r.empty_trials, "trial_id") == [5]
    assert ids(r.few_trial_neurons, "neuron_id") == [i for i in range(6) if seen[:, i].sum() < 4]
    assert ids(r.rank_deficient_neurons, "neuron_id") == [i for i in range(6) if seen[:, i].any() and np.linalg.matrix_rank(centred(i)) < 2] != []
    assert len(r.problems) == 1 and len(r.warnings) == 2 and "trials without" in r.warnings[0]
    ridged = prepare.check_design(design, obs, ridge=0.1)
    assert ids(ridged.rank_deficient_neurons, "neuron_id") == [] and ids(ridged.few_trial_neurons, "neuron_id") == []
    assert prepare.check_design(design_of(spark, x)).duplicates == ((0, 2),)
    with pytest.raises(ParameterError):
        prepare.check_design(design, obs, min_observations=0)


def test_fit_warns_of_what_the_report_finds(spark):
    x, y = sample()
    y[0] = np.nan
    y[x[:, 1] < np.median(x[:, 1]), 0] = np.nan
    y[np.flatnonzero(~np.isnan(y[:, 0, 0]))[2:], 0] = np.nan  # two trials, three coefficients
    with pytest.warns(DesignWarning) as found:
        LowRankRegression(ranks=[1, 1], estimator="svd", ridge=0.0, min_observations=1).fit(rows_of(spark, y), design_of(spark, x))
    said = " ".join(str(w.message) for w in found)
    assert "trials without an observed neuron: 0" in said and "rank-deficient: 0" in said


def test_streaming_equals_one_pass(spark, tmp_path):
    from strand.streaming.moments import running_moments

    x, y = sample(drop=0.1)
    obs, design = frames.observed(rows_of(spark, y)), design_of(spark, x)
    for part in (0, 1):
        obs.where(F.col("trial_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = running_moments(stream, design, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = collected(spark.read.parquet(str(tmp_path / "out/version=1")))
    np.testing.assert_allclose(last.xty, from_arrays(y, x).xty, rtol=1e-8, atol=1e-8)
