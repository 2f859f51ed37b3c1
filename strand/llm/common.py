"""Helpers shared by the corpus operators: inputs, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast (after counting it).
BROADCAST_ROWS = 300_000

#: ASCII white space between words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]"

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers that start in another folder import this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone; the folder's owner cleans up
        return


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="strand-")
        _ROOTS[app] = f"{base.rstrip('/')}/strand-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a saved table for broadcast if it has at most `most` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
