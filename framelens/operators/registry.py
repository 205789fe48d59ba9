"""Hooks for user models and transforms.

Named transforms need no registry here: ``DataFrame.transform`` takes any function, and ``spark.udf`` and ``spark.udtf``
register those that SQL shall know; ``SparkContext.addPyFile`` ships their modules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]

DETECTION_SCHEMA = (
    "det_id long, x1 double, y1 double, x2 double, y2 double, det_score double, "
    "kps array<struct<x:double,y:double>>, embedding array<float>"
)


def detect(
    images: DataFrame, factory: Callable[[], Callable[[bytes], Iterable[dict]]], *, keys: Sequence[str] = ("path",),
    content: str = "content", schema: str = DETECTION_SCHEMA,
) -> DataFrame:
    """Zero or more detections per image from a user model, which is built once per task.

    ``factory()`` returns a function from image bytes to detection dicts.
    """
    keys = list(keys)
    key_ddl = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            out = []
            for row in zip(*(batch[c].tolist() for c in (*keys, content))):
                for i, found in enumerate(model(row[-1])):
                    filled = {"det_id": i, **found}
                    out.append((*row[:-1], *(filled.get(n) for n in names)))
            yield pd.DataFrame(out, columns=[*keys, *names])

    return images.select(*keys, content).mapInPandas(run, f"{key_ddl}, {schema}")


def detector_udtf(factory: Callable[[], Callable[[bytes], Iterable[dict]]], schema: str = DETECTION_SCHEMA):
    """The same hook as a table function, for lateral joins in SQL."""
    names = [f.split()[0] for f in schema.split(", ")]

    class Detector:
        def __init__(self):
            self.model = factory()

        def eval(self, content):
            for i, found in enumerate(self.model(bytes(content))):
                filled = {"det_id": i, **found}
                yield tuple(filled.get(n) for n in names)

    return F.udtf(Detector, returnType=schema)


def enrich(
    df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], inputs: Sequence[str], schema: str,
    name: str = "geometry",
) -> DataFrame:
    """Add a struct column from a user estimator; a row it has no answer for gets a null struct field."""

    @F.pandas_udf(schema)
    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield model(batch)

    return df.withColumn(name, estimate(F.struct(*inputs)))


def transform_or_identity(df: DataFrame, transform: Transform | None = None) -> DataFrame:
    """An optional step: without a transform the plan is left as it is."""
    return df if transform is None else df.transform(transform)
