"""Queries over the driver's tables, each with the SQL it must equal where SQL can say it.

lineitem as data: a neuron is a supplier, a trial a ship month, a bin a return flag
(A, N, R), y the mean quantity; neuron-trials without all three bins are unobserved.
Regressors: the month centred and scaled, and the half-year as -1 or 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import criteria, kernels
from .operators import evaluate, prepare, report
from .operators.moments import Moments, collected, moments, moments_sql
from .plans import distributed
from .plans.estimator import LowRankRegression
from .plans.fit import ecme, fit_least_squares, fit_marginal, marginal_log_likelihood
from .plans.search import greedy_search
from .sources import frames, synth

CELLS = """
 SELECT l_suppkey AS neuron_id, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS BIGINT) AS trial_id,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS bin, avg(l_quantity) AS v
 FROM lineitem GROUP BY 1, 2, 3"""


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial_id, neuron_id, y) with NaN in the bins without items."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = spark.sql(CELLS.replace("FROM lineitem", "FROM {lines}"), lines=lines)
    y = [F.coalesce(F.max(F.when(F.col("bin") == k, F.col("v"))), F.lit(float("nan"))) for k in range(3)]
    return cells.groupBy("trial_id", "neuron_id").agg(F.array(*y).alias("y"))


def lineitem_design(rows: DataFrame, width: int = 2) -> DataFrame:
    month = F.col("trial_id")
    x = [(month - 41) / F.lit(24.0), F.when(month % 12 < 6, F.lit(-1.0)).otherwise(F.lit(1.0))]
    return rows.select("trial_id").distinct().select("trial_id", F.array(*x[:width]).alias("x"))


def data(spark, sf_dir, width=2):
    rows = lineitem_rows(spark, sf_dir)
    return frames.observed(rows), lineitem_design(rows, width)


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


WIDE = f"""
 cells AS ({CELLS}),
 wide AS (SELECT neuron_id, trial_id, max(v) FILTER (bin = 0) AS y0, max(v) FILTER (bin = 1) AS y1, max(v) FILTER (bin = 2) AS y2
          FROM cells GROUP BY neuron_id, trial_id),
 trials AS (SELECT DISTINCT trial_id, (trial_id - 41) / 24.0::DOUBLE AS x0, CASE WHEN trial_id % 12 < 6 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS x1 FROM wide),
 obs AS (SELECT w.*, t.x0, t.x1 FROM wide w JOIN trials t USING (trial_id) WHERE y0 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL),
 long AS (SELECT neuron_id, trial_id, x0, x1, unnest([0, 1, 2]) AS bin, unnest([y0, y1, y2]) AS y FROM obs),
 ols AS (SELECT neuron_id, bin, count(*) AS n, regr_slope(y, x0) AS b, regr_intercept(y, x0) AS a,
                regr_syy(y, x0) - regr_sxy(y, x0) * regr_sxy(y, x0) / regr_sxx(y, x0) AS rss FROM long GROUP BY neuron_id, bin),
 noise AS (SELECT neuron_id, max(n) AS n, max(n) * 3 / sum(rss) AS lam, sum(rss) AS rss FROM ols GROUP BY neuron_id)"""


def q_mask(spark, sf_dir):
    obs, _ = data(spark, sf_dir)
    return obs.select("trial_id", "neuron_id", F.posexplode("y").alias("bin", "v")).select("trial_id", "neuron_id", "bin", _r("v").alias("y"))


SQL_MASK = f"WITH {WIDE} SELECT trial_id, neuron_id, bin, round(y, 6) + 0.0 AS y FROM long"


def _long_moments(stats: DataFrame) -> DataFrame:
    p, t = 2, 3
    cells = F.explode(F.sequence(F.lit(0), F.lit(p * t - 1))).alias("c")
    flat = stats.select("*", cells).select("*", F.expr(f"cast(c div {t} as int)").alias("p"), F.expr(f"cast(c % {t} as int)").alias("bin"))
    return flat.select(
        "neuron_id",
        "p",
        "bin",
        "n_obs",
        _r(F.get("x_mean", F.col("p"))).alias("x_mean"),
        _r(F.get("y_mean", F.col("bin"))).alias("y_mean"),
        _r(F.get("xtx_c", F.col("p") * (p + 1))).alias("xx"),
        _r(F.get("xty_c", F.col("c"))).alias("xy"),
    )


def q_moments(spark, sf_dir):
    return _long_moments(moments(*data(spark, sf_dir)))


def q_moments_sql(spark, sf_dir):
    rows = moments_sql(*data(spark, sf_dir))
    return rows.select("neuron_id", "p", "bin", "n_obs", _r("x_mean").alias("x_mean"), _r("y_mean").alias("y_mean"), _r("xx").alias("xx"), _r("xy").alias("xy"))


SQL_MOMENTS = f"""
WITH {WIDE}, pairs AS (SELECT neuron_id, bin, y, unnest([0, 1]) AS p, unnest([x0, x1]) AS x FROM long)
SELECT neuron_id, p, bin, count(*) AS n_obs, round(avg(x), 6) + 0.0 AS x_mean, round(avg(y), 6) + 0.0 AS y_mean,
       round(regr_sxx(y, x), 6) + 0.0 AS xx, round(regr_sxy(y, x), 6) + 0.0 AS xy
FROM pairs GROUP BY neuron_id, p, bin"""


def q_least_squares(spark, sf_dir):
    out = distributed.coefficients_full(moments(*data(spark, sf_dir, 1)))
    flat = out.select("neuron_id", "noise_precision", "log_likelihood", F.posexplode(F.arrays_zip("b", "intercept")).alias("bin", "z"))
    return flat.select("neuron_id", "bin", _r("z.b").alias("slope"), _r("z.intercept").alias("intercept"), _r("noise_precision").alias("noise_precision"), _r("log_likelihood", 4).alias("log_likelihood"))


SQL_LEAST_SQUARES = f"""
WITH {WIDE}
SELECT neuron_id, bin, round(b, 6) + 0.0 AS slope, round(a, 6) + 0.0 AS intercept, round(lam, 6) + 0.0 AS noise_precision,
       round(-0.5 * m.n * 3 * (ln(m.rss / (m.n * 3)) + 1 + ln(2 * pi())), 4) + 0.0 AS log_likelihood
FROM ols JOIN noise m USING (neuron_id)"""


def q_least_squares_two(spark, sf_dir):
    out = distributed.coefficients_full(moments(*data(spark, sf_dir)))
    return out.select("neuron_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("bin"), "b").select(
        "neuron_id", "bin", _r(F.get("b", F.col("bin"))).alias("b0"), _r(F.get("b", F.col("bin") + 3)).alias("b1")
    )


SQL_LEAST_SQUARES_TWO = f"""
WITH {WIDE}, s AS (SELECT neuron_id, bin, covar_pop(x0, x0) AS a, covar_pop(x0, x1) AS b, covar_pop(x1, x1) AS d, covar_pop(x0, y) AS u, covar_pop(x1, y) AS v FROM long GROUP BY neuron_id, bin)
SELECT neuron_id, bin, round((d * u - b * v) / (a * d - b * b), 6) + 0.0 AS b0, round((a * v - b * u) / (a * d - b * b), 6) + 0.0 AS b1 FROM s"""


def _params(spark, sf_dir, width=1):
    obs, design = data(spark, sf_dir, width)
    return obs, design, distributed.coefficients_full(moments(obs, design)).drop("log_likelihood")


def q_predict(spark, sf_dir):
    _, design, params = _params(spark, sf_dir)
    out = evaluate.predict(design, params)
    return out.select("trial_id", "neuron_id", F.posexplode("y").alias("bin", "v")).select("trial_id", "neuron_id", "bin", _r("v").alias("y"))


SQL_PREDICT = f"WITH {WIDE} SELECT trial_id, neuron_id, bin, round(a + b * x0, 6) + 0.0 AS y FROM trials CROSS JOIN ols"


def q_log_likelihood(spark, sf_dir):
    obs, design, params = _params(spark, sf_dir)
    out = evaluate.log_likelihood(obs, design, params, per_trial=True)
    return out.select("trial_id", _r("log_likelihood", 5).alias("log_likelihood"))


SQL_LOG_LIKELIHOOD = f"""
WITH {WIDE}
SELECT trial_id, round(sum(0.5 * (ln(lam) - ln(2 * pi())) - 0.5 * lam * (y - a - b * x0) * (y - a - b * x0)), 5) + 0.0 AS log_likelihood
FROM long JOIN ols USING (neuron_id, bin) JOIN noise USING (neuron_id) GROUP BY trial_id"""


def q_explained_variance(spark, sf_dir):
    obs, design, params = _params(spark, sf_dir)
    return evaluate.explained_variance(obs, design, params, ["month"]).select("term", _r("explained").alias("explained"))


_EXPLAINED = f"""
WITH {WIDE}, m AS (SELECT neuron_id, avg(y) AS mean FROM long GROUP BY neuron_id),
e AS (SELECT bin, y, mean, mean + b * x0 AS g1, a AS g2, a + b * x0 AS g3 FROM long JOIN ols USING (neuron_id, bin) JOIN m USING (neuron_id)),
s AS (SELECT @1 sum((y - mean) ^ 2) AS e0, [sum((y - g1) ^ 2), sum((y - g2) ^ 2), sum((y - g3) ^ 2)] AS es FROM e @2)
SELECT @1 unnest(['month', 'intercept', 'total']) AS term, unnest(list_transform(es, lambda x: round(1 - x / e0, 6) + 0.0)) AS explained FROM s"""
SQL_EXPLAINED = _EXPLAINED.replace("@1", "").replace("@2", "")


def q_explained_per_bin(spark, sf_dir):
    obs, design, params = _params(spark, sf_dir)
    return evaluate.explained_variance(obs, design, params, ["month"], per_bin=True).select("bin", "term", _r("explained").alias("explained"))


SQL_EXPLAINED_PER_BIN = _EXPLAINED.replace("@1", "bin,").replace("@2", "GROUP BY bin")


def q_condition_average(spark, sf_dir):
    obs, design = data(spark, sf_dir)
    averages, _, _ = prepare.condition_average(obs, design, obs.select("neuron_id"), by=[1], min_trials=5)
    return averages.select("cond_id", "neuron_id", "n_trials", "mask", F.posexplode("y").alias("bin", "v")).select("cond_id", "neuron_id", "n_trials", "mask", "bin", _r("v").alias("y"))


SQL_CONDITION_AVERAGE = f"""
WITH {WIDE}, c AS (SELECT CAST(dense_rank() OVER (ORDER BY x1) - 1 AS BIGINT) AS cond_id, * FROM long)
SELECT cond_id, neuron_id, count(*) AS n_trials, TRUE AS mask, bin, round(avg(y), 6) + 0.0 AS y FROM c GROUP BY cond_id, neuron_id, bin HAVING count(*) >= 5"""


def q_condition_design(spark, sf_dir):
    obs, design = data(spark, sf_dir)
    _, xs, conds = prepare.condition_average(obs, design, obs.select("neuron_id"), by=[1])
    sizes = conds.groupBy("cond_id").agg(F.count("*").alias("trials"))
    return xs.join(sizes, "cond_id").select("cond_id", "trials", _r(F.get("x", F.lit(0))).alias("x0"), _r(F.get("x", F.lit(1))).alias("x1"))


SQL_CONDITION_DESIGN = f"""
WITH {WIDE} SELECT CAST(dense_rank() OVER (ORDER BY x1) - 1 AS BIGINT) AS cond_id, count(*) AS trials, round(avg(x0), 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1 FROM trials GROUP BY x1"""


def _sessions(spark, sf_dir):
    """Three sessions by trial; together they hold every observation."""
    obs, design = data(spark, sf_dir)
    return [(obs.where(F.col("trial_id") % 3 == s), design.where(F.col("trial_id") % 3 == s)) for s in range(3)]


def q_stack_sessions(spark, sf_dir):
    obs, design, _, _ = prepare.stack_sessions(_sessions(spark, sf_dir))
    rows = obs.join(design, "trial_id")
    return rows.select("trial_id", "neuron_id", _r(F.get("x", F.lit(0))).alias("x0"), F.posexplode("y").alias("bin", "v")).select("trial_id", "neuron_id", "x0", "bin", _r("v").alias("y"))


SQL_STACK_SESSIONS = f"""
WITH {WIDE}, t AS (SELECT trial_id AS old, trial_id % 3 AS s, CAST(row_number() OVER (ORDER BY trial_id % 3, trial_id) - 1 AS BIGINT) AS trial_id FROM trials),
n AS (SELECT neuron_id AS old, s, CAST(row_number() OVER (ORDER BY s, neuron_id) - 1 AS BIGINT) AS neuron_id
      FROM (SELECT DISTINCT neuron_id, trial_id % 3 AS s FROM obs))
SELECT t.trial_id, n.neuron_id, round(x0, 6) + 0.0 AS x0, bin, round(y, 6) + 0.0 AS y
FROM long l JOIN t ON t.old = l.trial_id JOIN n ON n.old = l.neuron_id AND n.s = t.s"""


def q_split_sizes(spark, sf_dir):
    _, design = data(spark, sf_dir)
    rows = design.select("trial_id", F.get("x", F.lit(1)).alias("half"))
    split = prepare.split_trials(rows, 0.25, seed=3, stratify="half")
    return split.groupBy("half").agg(F.count_if("test").alias("n_test"), F.count("*").alias("n"))


SQL_SPLIT_SIZES = f"""
WITH {WIDE} SELECT x1 AS half, CAST(greatest(1, least(count(*) - 1, round_even(count(*) * 0.25, 0))) AS BIGINT) AS n_test, count(*) AS n FROM trials GROUP BY x1"""


def q_design(spark, sf_dir):
    obs, design = data(spark, sf_dir)
    r = prepare.check_design(design, obs, per_neuron=False)  # q_design_neurons and q_empty_trials are the rest
    rows = [(n, int(r.n_trials), round(float(m), 6) + 0.0, round(float(s), 6) + 0.0, round(r.max_abs_correlation, 6), int(r.rank)) for n, m, s in zip(r.names, r.means, r.stds, strict=True)]
    return spark.createDataFrame(rows, "regressor string, n long, mean double, std double, max_corr double, rank long")


SQL_DESIGN = f"""
WITH {WIDE}, used AS (SELECT * FROM trials WHERE trial_id IN (SELECT trial_id FROM obs))
SELECT unnest(['x0', 'x1']) AS regressor, n, unnest([m0, m1]) AS mean, unnest([s0, s1]) AS std, c AS max_corr, CAST(2 AS BIGINT) AS rank FROM (
  SELECT count(*) AS n, round(avg(x0), 6) + 0.0 AS m0, round(avg(x1), 6) + 0.0 AS m1, round(stddev_pop(x0), 6) + 0.0 AS s0, round(stddev_pop(x1), 6) + 0.0 AS s1, round(abs(corr(x0, x1)), 6) AS c FROM used)"""


def q_design_neurons(spark, sf_dir):
    obs, design = data(spark, sf_dir)
    return prepare.design_neurons(obs, design, floor=4)


SQL_DESIGN_NEURONS = f"""
WITH {WIDE}
SELECT neuron_id, count(*) AS n_obs, count(*) < 4 AS few_trials,
       min(x0) = max(x0) OR min(x1) = max(x1) OR 1 - abs(corr(x0, x1)) <= 1e-10 AS rank_deficient
FROM obs GROUP BY neuron_id"""


def q_empty_trials(spark, sf_dir):
    """Months in which no supplier has items of all three flags."""
    obs, design = data(spark, sf_dir)
    return prepare.empty_trials(design, obs)


SQL_EMPTY_TRIALS = f"WITH {WIDE} SELECT trial_id FROM trials WHERE trial_id NOT IN (SELECT trial_id FROM obs)"


def q_counts(spark, sf_dir):
    obs, _ = data(spark, sf_dir)
    n = obs.select("neuron_id").distinct().count()
    rows = []
    for a in range(1, 4):
        for b in range(4):
            rows.append((a, b, criteria.count_least_squares([a, b], n, 3), criteria.count_least_squares([a, b], n, 3, formula="reference"), criteria.count_marginal([a, b], n, 3), criteria.count_marginal([a, b], n, 3, formula="reference")))
    return spark.createDataFrame(rows, "r0 long, r1 long, svd long, svd_sum long, mmle long, mmle_full long")


SQL_COUNTS = f"""
WITH {WIDE}, k AS (SELECT count(DISTINCT neuron_id) AS n FROM obs), g AS (SELECT a.r0, b.r1, n FROM (SELECT unnest([1, 2, 3]) AS r0) a, (SELECT unnest([0, 1, 2, 3]) AS r1) b, k)
SELECT CAST(r0 AS BIGINT) AS r0, CAST(r1 AS BIGINT) AS r1, CAST(r0 * (n + 3 - r0) + r1 * (n + 3 - r1) + n + 3 * n AS BIGINT) AS svd,
       CAST((3 * n + 9 - (r0 + r1 + 3)) * (r0 + r1 + 3) AS BIGINT) AS svd_sum,
       CAST(n + 3 * (r0 + r1) - r0 * (r0 - 1) // 2 - r1 * (r1 - 1) // 2 + 3 * n AS BIGINT) AS mmle, CAST(n + 3 * (r0 + r1) + 3 * n AS BIGINT) AS mmle_full FROM g"""


def q_coefficient_norms(spark, sf_dir):
    _, _, params = _params(spark, sf_dir)
    coef = params.select(F.lit("month").alias("regressor"), "neuron_id", "b")
    return evaluate.coefficient_norms(coef).select("regressor", "bin", _r("norm").alias("norm"))


SQL_COEFFICIENT_NORMS = f"WITH {WIDE} SELECT 'month' AS regressor, bin, round(sqrt(sum(b * b)), 6) + 0.0 AS norm FROM ols GROUP BY bin"

#: A parameter point for the closed-form checks: one basis, one precision, zero intercept replaced by the means.
POINT_S, POINT_LAM = (0.5, -0.2, 0.3), 0.01


def _one(spark, sf_dir) -> Moments:
    return collected(moments(*data(spark, sf_dir, 1)))


def q_marginal(spark, sf_dir):
    m = _one(spark, sf_dir)
    s, lam = [np.array(POINT_S)[:, None]], np.full(len(m.n), POINT_LAM)
    b = kernels.blocks(s)
    xty, yty = m.about(m.y_mean)
    st = kernels.state(b, lam, m.xtx_raw(), xty)
    terms = kernels.nll_terms(st, lam, yty, m.n, 3)
    rows = [(int(i), round(float(v), 4) + 0.0, round(float(u[0]), 6) + 0.0) for i, v, u in zip(m.ids, terms, st.mu, strict=True)]
    return spark.createDataFrame(rows, "neuron_id long, nll double, weight double")


_SCALAR = f"""
WITH {WIDE}, agg AS (SELECT neuron_id, bin, count(*) AS n, regr_sxx(y, x0) AS sxx, avg(x0) AS xm, regr_sxy(y, x0) AS sxy, regr_syy(y, x0) AS syy, avg(y) AS ym,
   CASE bin WHEN 0 THEN {POINT_S[0]} WHEN 1 THEN {POINT_S[1]} ELSE {POINT_S[2]} END AS s FROM long GROUP BY neuron_id, bin),
per AS (SELECT neuron_id, max(n) AS n, max(sxx) + max(n) * max(xm) * max(xm) AS a, sum(s * sxy) AS u, sum(syy) AS v, {POINT_LAM}::DOUBLE AS lam, sum(s * s) AS ss FROM agg GROUP BY neuron_id),
st AS (SELECT *, a * ss AS k, 1 + lam * a * ss AS c, lam * u / (1 + lam * a * ss) AS mu FROM per)"""
SQL_MARGINAL = f"""{_SCALAR}
SELECT neuron_id, round(0.5 * (-n * 3 * (ln(lam) - ln(2 * pi())) + ln(c) + lam * v - lam * lam * u * u / c), 4) + 0.0 AS nll, round(mu, 6) + 0.0 AS weight FROM st"""


def q_ecme_step(spark, sf_dir):
    m = _one(spark, sf_dir)
    fit = ecme(m, [np.array(POINT_S)[:, None]], np.full(len(m.n), POINT_LAM), m.y_mean, max_iter=1)
    rows = [(int(i), round(float(v), 6) + 0.0) for i, v in zip(m.ids, fit.precision, strict=True)]
    return spark.createDataFrame(rows, "neuron_id long, precision double")


SQL_ECME_STEP = f"""{_SCALAR}
SELECT neuron_id, round(n * 3 / (v - 2 * u * mu + k * (mu * mu + 1 / c)), 6) + 0.0 AS precision FROM st"""


def q_ecme_basis(spark, sf_dir):
    m = _one(spark, sf_dir)
    fit = ecme(m, [np.array(POINT_S)[:, None]], np.full(len(m.n), POINT_LAM), m.y_mean, max_iter=1)
    return spark.createDataFrame([(t, round(float(v), 6) + 0.0) for t, v in enumerate(fit.bases[0][:, 0])], "bin int, s double")


SQL_ECME_BASIS = f"""{_SCALAR}, l2 AS (SELECT *, n * 3 / (v - 2 * u * mu + k * (mu * mu + 1 / c)) AS l FROM st),
z AS (SELECT neuron_id, l, a, l * u / (1 + l * k) AS m2, 1 / (1 + l * k) AS v2 FROM l2)
SELECT bin, round(sum(l * m2 * sxy) / sum(l * a * (m2 * m2 + v2)), 6) + 0.0 AS s FROM z JOIN agg USING (neuron_id) GROUP BY bin"""


def q_decode(spark, sf_dir):
    obs, _, params = _params(spark, sf_dir)
    out = evaluate.decode(obs, params, 1, [0])
    return out.select("trial_id", _r(F.get("values", F.lit(0))).alias("x0"))


SQL_DECODE = f"WITH {WIDE} SELECT trial_id, round(sum(lam * b * (y - a)) / sum(lam * b * b), 6) + 0.0 AS x0 FROM long JOIN ols USING (neuron_id, bin) JOIN noise USING (neuron_id) GROUP BY trial_id"


def q_decode_llr(spark, sf_dir):
    obs, _, params = _params(spark, sf_dir)
    out = evaluate.decode(obs, params, 1, [0], levels={0: [-1.0, 1.0]})
    return out.select("trial_id", _r(F.get("values", F.lit(0))).alias("x0"), _r("llr", 5).alias("llr"))


SQL_DECODE_LLR = f"""
WITH {WIDE}, p AS (SELECT trial_id, sum(-0.5 * lam * ((y - a - b) ^ 2 - (y - a + b) ^ 2)) AS llr FROM long JOIN ols USING (neuron_id, bin) JOIN noise USING (neuron_id) GROUP BY trial_id)
SELECT trial_id, CASE WHEN llr > 0 THEN 1.0 ELSE -1.0 END AS x0, round(llr, 5) + 0.0 AS llr FROM p"""


def q_project(spark, sf_dir):
    obs, _, params = _params(spark, sf_dir)
    weights = params.select("neuron_id", F.array(F.get("b", F.lit(0))).alias("w"))
    out = evaluate.project(obs, weights, params)
    return out.select("trial_id", F.posexplode("z").alias("bin", "v")).select("trial_id", "bin", _r("v").alias("z"))


SQL_PROJECT = f"""
WITH {WIDE}, w AS (SELECT neuron_id, b AS w FROM ols WHERE bin = 0)
SELECT trial_id, bin, round(sum(lam * w * (y - a)) / sum(lam * w * w), 6) + 0.0 AS z FROM long JOIN ols USING (neuron_id, bin) JOIN noise USING (neuron_id) JOIN w USING (neuron_id) GROUP BY trial_id, bin"""


def q_rank_search(spark, sf_dir):
    m = collected(moments(*data(spark, sf_dir)))
    _, history = greedy_search(lambda r: fit_least_squares(m, r), lambda f, r: f.aic, [1, 1], 3, names=("month", "half"))
    return report.history_frame(spark, history)


def q_low_rank(spark, sf_dir):
    m = collected(moments(*data(spark, sf_dir)))
    fit = fit_least_squares(m, [1, 1], precision_weighted=True)
    return spark.createDataFrame([(int(i), float(v)) for i, v in zip(m.ids, fit.precision, strict=True)], "neuron_id long, noise_precision double")


def q_marginal_fit(spark, sf_dir):
    rows = lineitem_rows(spark, sf_dir)
    model = LowRankRegression(ranks=[1, 1]).fit(rows, lineitem_design(rows), names=["month", "half"])
    return report.fit_frames(spark, model)["summary"]


def q_distributed_likelihood(spark, sf_dir):
    stats = moments(*data(spark, sf_dir, 1))
    params = stats.select("neuron_id", F.lit(POINT_LAM).alias("precision"), F.col("y_mean").alias("intercept"))
    value, grads = distributed.marginal_value_and_gradient(stats, [np.array(POINT_S)[:, None]], params)
    return spark.createDataFrame([(round(value, 3), *(round(float(g), 4) + 0.0 for g in grads[0][:, 0]))], "nll double, g0 double, g1 double, g2 double")


SQL_DISTRIBUTED_LIKELIHOOD = f"""{_SCALAR}, e AS (SELECT bin, sum(lam * (a * (mu * mu + 1 / c) * s - mu * sxy)) AS g FROM st JOIN agg USING (neuron_id) GROUP BY bin)
SELECT round(sum(0.5 * (-n * 3 * (ln(lam) - ln(2 * pi())) + ln(c) + lam * v - lam * lam * u * u / c)), 3) AS nll,
       (SELECT round(g, 4) + 0.0 FROM e WHERE bin = 0) AS g0, (SELECT round(g, 4) + 0.0 FROM e WHERE bin = 1) AS g1, (SELECT round(g, 4) + 0.0 FROM e WHERE bin = 2) AS g2 FROM st"""


def q_simulation(spark, sf_dir):
    truth = synth.draw_truth(n_neurons=30, n_bins=6, n_trials=120, ranks=(2, 1), seed=4)
    obs, design = synth.simulate(spark, truth, drop_prob=0.2, seed=4)
    model = LowRankRegression(ranks=[2, 1], estimator="svd").fit(obs, design)
    return report.fit_frames(spark, model)["coef"]


QUERIES = {
    "least_squares": q_least_squares,
    "mask": q_mask,
    "moments": q_moments,
    "moments_builtin": q_moments_sql,
    "least_squares_two": q_least_squares_two,
    "predict": q_predict,
    "log_likelihood": q_log_likelihood,
    "explained_variance": q_explained_variance,
    "explained_variance_bins": q_explained_per_bin,
    "condition_average": q_condition_average,
    "condition_design": q_condition_design,
    "stack_sessions": q_stack_sessions,
    "split_sizes": q_split_sizes,
    "check_design": q_design,
    "design_neurons": q_design_neurons,
    "empty_trials": q_empty_trials,
    "parameter_counts": q_counts,
    "coefficient_norms": q_coefficient_norms,
    "marginal_likelihood": q_marginal,
    "ecme_precision": q_ecme_step,
    "ecme_basis": q_ecme_basis,
    "decode": q_decode,
    "decode_llr": q_decode_llr,
    "project": q_project,
    "distributed_likelihood": q_distributed_likelihood,
    "rank_search": q_rank_search,
    "low_rank": q_low_rank,
    "marginal_fit": q_marginal_fit,
    "simulation": q_simulation,
}

ORACLES = {
    "least_squares": SQL_LEAST_SQUARES,
    "mask": SQL_MASK,
    "moments": SQL_MOMENTS,
    "moments_builtin": SQL_MOMENTS,
    "least_squares_two": SQL_LEAST_SQUARES_TWO,
    "predict": SQL_PREDICT,
    "log_likelihood": SQL_LOG_LIKELIHOOD,
    "explained_variance": SQL_EXPLAINED,
    "explained_variance_bins": SQL_EXPLAINED_PER_BIN,
    "condition_average": SQL_CONDITION_AVERAGE,
    "condition_design": SQL_CONDITION_DESIGN,
    "stack_sessions": SQL_STACK_SESSIONS,
    "split_sizes": SQL_SPLIT_SIZES,
    "check_design": SQL_DESIGN,
    "design_neurons": SQL_DESIGN_NEURONS,
    "empty_trials": SQL_EMPTY_TRIALS,
    "parameter_counts": SQL_COUNTS,
    "coefficient_norms": SQL_COEFFICIENT_NORMS,
    "marginal_likelihood": SQL_MARGINAL,
    "ecme_precision": SQL_ECME_STEP,
    "ecme_basis": SQL_ECME_BASIS,
    "decode": SQL_DECODE,
    "decode_llr": SQL_DECODE_LLR,
    "project": SQL_PROJECT,
    "distributed_likelihood": SQL_DISTRIBUTED_LIKELIHOOD,
}
