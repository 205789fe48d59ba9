"""Session helpers: checkpoints and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A machine-local folder is chosen only when the session names none, as in local tests.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, *, eager: bool = True) -> DataFrame:
    """Reliable checkpoint, so an iterative plan stays short and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def bounded(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Materialise a table that should be small, and mark it for broadcast if it has at most ``max_rows`` rows.

    A larger one is left to an ordinary shuffled join. Estimates are no help here, since they take an
    aggregate for as large as its input.
    """
    held = cut_lineage(df)
    return F.broadcast(held) if held.count() <= max_rows else held
