"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import contextlib
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The configuration of the recorded single-node figures: neurons, bins, trials, ranks.
PAPER = dict(n_neurons=800, n_bins=15, n_trials=1000, ranks=(5, 4, 3, 4, 2, 2))
DEMO = dict(n_neurons=100, n_bins=15, n_trials=400, ranks=(2, 1, 3))


def arrays(config: dict):
    import numpy as np

    from strand.sources.synth import draw_truth

    truth = draw_truth(**config, seed=1)
    rng = np.random.default_rng(2)
    shape = (len(truth.x), *truth.intercept.shape)
    y = truth.intercept + np.einsum("kp,pnt->knt", truth.x, np.stack(truth.coefficients)) + rng.standard_normal(shape) / np.sqrt(truth.precision)[None, :, None]
    y[rng.random(shape[:2]) < 0.3] = np.nan
    return y, truth.x


def kernels() -> dict:
    """The recorded workloads on arrays in one process."""
    from strand.operators.moments import from_arrays
    from strand.plans.estimator import LowRankRegression
    from strand.plans.fit import fit_least_squares, fit_marginal

    out = {}
    y, x = arrays(PAPER)

    def timed(name, f):
        start = time.time()
        result = f()
        out[name] = round(time.time() - start, 4)
        return result

    timed("paper_moments_and_svd", lambda: fit_least_squares(from_arrays(y, x), PAPER["ranks"]))
    y, x = arrays(DEMO)
    m = from_arrays(y, x)
    timed("demo_mmle", lambda: fit_marginal(m, DEMO["ranks"]))
    timed("demo_search", lambda: LowRankRegression().fit_moments(m))
    return out


def main() -> None:
    import warnings

    warnings.simplefilter("ignore")
    from pyspark.sql import SparkSession

    from strand.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in QUERIES.items():
        with contextlib.suppress(Exception):
            query(spark, SF).count() if name == next(iter(QUERIES)) else None
        start = time.time()
        query(spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    times |= kernels()
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF}))


if __name__ == "__main__":
    main()
