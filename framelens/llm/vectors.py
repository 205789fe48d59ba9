"""Vector columns as arrays, shared by the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import NO_ID, save


def usable(column: str) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    c = F.col(column)
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def one_vector_per_id(df: DataFrame, kind: str = "array<double>", written: bool = False) -> DataFrame:
    """``_id, v``, one row per id: a null id counts as one more, of repeated ids the largest vector stays.

    ``written``: rows that had to be grouped for it are a written table, for those who read them again and again.
    """
    rows = df.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.col("embedding").cast(kind).alias("v"))
    if rows.groupBy("_id").count().where("count > 1").limit(1).isEmpty():
        return rows
    grouped = rows.groupBy("_id").agg(F.max("v").alias("v"))
    return save(grouped, "vectors") if written else grouped


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, zeros behind vectors shorter than ``width``."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
