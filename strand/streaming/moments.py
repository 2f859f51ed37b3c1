"""Running sufficient statistics of a stream of observations.

Each micro-batch is reduced to moments and merged into a table of them, which the next
batch reads: moments merge exactly, so the table always equals one pass over all rows.
Versions are numbered by batch, so a batch replayed after a failure starts from the
version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.moments import SCHEMA, _merge_typed, moments


def running_moments(stream: DataFrame, design: DataFrame, path: str) -> DataStreamWriter:
    """A writer that keeps `path/version=<batch>` up to date from a stream of obs rows; start() it."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = moments(batch, design)
        if batch_id:
            old = spark.read.schema(SCHEMA).parquet(f"{path}/version={batch_id - 1}")
            new = old.unionByName(new).groupBy("neuron_id").applyInArrow(_merge_typed, SCHEMA)
        new.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return stream.writeStream.foreachBatch(step)
