"""spark-submit job: forecasts, ensemble and loss table of a panel of bars.

    spark-submit --py-files volpanel.zip walk.py BARS_PARQUET OUT_FOLDER OOS_START
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from volpanel.operators import ensemble, metrics, prep, recursion
from volpanel.sources.schema import MODELS, TARGETS, Parameters


def run(spark: SparkSession, source: str, out: str, oos: str) -> None:
    """Write ``out/ensemble`` and ``out/metrics`` from clean bars (asset, date, open, high, low, close)."""
    paths = recursion.variance_paths(prep.returns(spark.read.parquet(source)), oos, Parameters())
    ensemble.inverse_rmse_ensemble(paths, oos).write.parquet(f"{out}/ensemble")
    written = spark.read.parquet(f"{out}/ensemble")
    models = [*MODELS, "static_ensemble_variance"]
    metrics.ranking(metrics.forecast_metrics(written, models, list(TARGETS))).write.parquet(f"{out}/metrics")


if __name__ == "__main__":
    run(SparkSession.builder.appName("volpanel-walk").getOrCreate(), *sys.argv[1:4])
