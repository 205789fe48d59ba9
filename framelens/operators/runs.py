"""Masks as runs: rows (frame_id, cy, x0, x1) for the cells x0 to x1 of a line.

A mask of an 8K frame has some ten million cells but some ten thousand runs, so labels, overlaps and unions work on runs and
cells are never opened. Frames are cut into strips of lines: a task labels one strip, and only runs on the borders of
strips meet again, one frame at a time, to join their labels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import Box
from framelens.functions.boxes import face_ellipse
from framelens.operators.grid import FOREGROUND, MIN_COMPONENT_OVERLAP, MIN_INSTANCE_OVERLAP, run_parts, uncovered_instances
from framelens.session import cut_lineage

#: Lines of a strip: one border line in so many has to be looked at twice.
STRIP = 256


def component_runs(
    cells: DataFrame, min_area: int = 12, *, key: str = "frame_id", value: str = "v", threshold: int = FOREGROUND,
    height: int | None = None, strip: int = STRIP,
) -> DataFrame:
    """(frame, cy, x0, x1, component, area): runs of the 8-connected components of at least ``min_area`` cells.

    ``component`` is the smallest cell number (cy * 2^31 + cx). ``height`` spares the look at borders where all lines
    fit one strip.
    """
    front = cells.filter(F.col(value) >= threshold).select(key, "cx", "cy")
    runs = _strip_runs(front, key, strip)
    component = F.col("part")
    if height is None or height > strip:
        runs = runs.join(_joined_parts(runs, key, strip), [key, "part"], "left")
        component = F.coalesce("joined", "part")
    named = runs.withColumn("component", component)
    area = F.sum(run_length()).over(Window.partitionBy(key, "component"))
    return named.withColumn("area", area).filter(F.col("area") >= min_area).select(key, "cy", "x0", "x1", "component", "area")


def run_length():
    return F.col("x1") - F.col("x0") + 1


def _whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, never ending within a group of equal ``names``; several groups may come at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        last = rows.num_rows - 1
        same = np.ones(rows.num_rows, bool)
        for name in names:
            column = rows.column(name).to_numpy(zero_copy_only=False)
            same &= column == column[last]
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if begin:
            yield rows.slice(0, begin)
        held = [rows.slice(begin)]
    yield from held


def _changes(rows: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """A number per row that grows with each new group."""
    new = np.zeros(rows.num_rows, bool)
    for name in names:
        column = rows.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _strip_runs(front: DataFrame, key: str, strip: int) -> DataFrame:
    """(frame, cy, x0, x1, part): runs, labelled within their strip. One shuffle of the cells, by strip."""
    kind = front.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, (key, "strip")):
            ys, xs = rows.column("cy").to_numpy(), rows.column("cx").to_numpy()
            first, last, part = run_parts(_changes(rows, (key, "strip")), ys, xs)
            yield pa.RecordBatch.from_arrays(
                [rows.column(key).take(pa.array(first)), pa.array(ys[first], pa.int64()), pa.array(xs[first], pa.int64()), pa.array(xs[last], pa.int64()), pa.array(part)],
                names=[key, "cy", "x0", "x1", "part"],
            )

    placed = front.filter(F.col(key).isNotNull()).select(key, F.floor(F.col("cy") / strip).cast("long").alias("strip"), F.col("cy").cast("long").alias("cy"), F.col("cx").cast("long").alias("cx"))
    arranged = placed.repartition(key, "strip").sortWithinPartitions(key, "strip", "cy", "cx")
    return arranged.mapInArrow(run, f"`{key}` {kind}, cy long, x0 long, x1 long, part long")


def _joined_parts(runs: DataFrame, key: str, strip: int) -> DataFrame:
    """(frame, part, joined): the smallest cell number of parts that go on in another strip. A task holds a frame's border lines."""
    kind = runs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, (key,)):
            cy, x0, x1, part = (rows.column(c).to_numpy() for c in ("cy", "x0", "x1", "part"))
            frame = _changes(rows, (key,))
            lines = np.flatnonzero(np.append(True, (np.diff(cy) != 0) | (np.diff(frame) != 0)))
            ends = np.append(lines[1:], len(cy))
            parent: dict[tuple[int, int], int] = {}

            def root(f: int, p: int) -> int:
                while parent.get((f, p), p) != p:
                    parent[f, p] = parent.get((f, parent[f, p]), parent[f, p])
                    p = parent[f, p]
                return p

            for i in range(len(lines) - 1):
                a, b, c = lines[i], ends[i], ends[i + 1]
                if cy[a] % strip != strip - 1 or cy[b] != cy[a] + 1 or frame[b] != frame[a]:
                    continue
                low = np.searchsorted(x1[b:c], x0[a:b] - 1, side="left")
                high = np.searchsorted(x0[b:c], x1[a:b] + 1, side="right")
                upper = np.repeat(np.arange(a, b), np.maximum(0, high - low))
                lower = b + np.concatenate([np.arange(s, e) for s, e in zip(low, high)]) if len(upper) else upper
                for p, q in zip(part[upper].tolist(), part[lower].tolist()):
                    p, q = root(int(frame[a]), p), root(int(frame[a]), q)
                    parent[int(frame[a]), max(p, q)] = min(p, q)
            met, where = np.unique(np.stack([frame, part], 1), axis=0, return_index=True)
            joined = [root(f, p) for f, p in met.tolist()]
            yield pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(where)), pa.array(met[:, 1]), pa.array(joined, pa.int64())], names=[key, "part", "joined"])

    border = runs.filter((F.col("cy") % strip == 0) | (F.col("cy") % strip == strip - 1)).select(key, "cy", "x0", "x1", "part")
    return border.repartition(key).sortWithinPartitions(key, "cy", "x0").mapInArrow(run, f"`{key}` {kind}, part long, joined long")


def instance_spans(instances: DataFrame, width: int, height: int, *, key: str = "frame_id", expand: float = 1.08) -> DataFrame:
    """(frame, instance, cy, x0, x1): each instance's oriented ellipse within the frame, one row per line, in closed form."""
    reach = 0.6 * F.greatest(F.lit(2.0), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * max(0.75, expand) + 3
    middle = (F.col("y1") + F.col("y2")) / 2
    bound = lambda at: F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(height - 1).cast("long"))
    point = lambda i: (F.get("kps", F.lit(i))["x"], F.get("kps", F.lit(i))["y"])
    eyes = F.coalesce(F.size("kps") >= 2, F.lit(False))
    left, right = (tuple(F.when(eyes, v).otherwise(F.lit(0.0)) for v in point(i)) for i in (0, 1))
    lines = instances.withColumn("cy", F.explode(F.sequence(bound(F.floor(middle - reach)), bound(F.ceil(middle + reach)))))
    ellipse = face_ellipse(Box.of(), expand=expand, variant="oriented", left_eye=left, right_eye=right)
    first, last = ellipse.span(F.col("cy").cast("double"))
    cut = lines.withColumns({"_x0": F.greatest(F.lit(0).cast("long"), first), "_x1": F.least(F.lit(width - 1).cast("long"), last)})
    cut = cut.filter(first.isNotNull() & last.isNotNull() & (F.col("_x0") <= F.col("_x1")))
    return cut.select(key, "instance", "cy", F.col("_x0").alias("x0"), F.col("_x1").alias("x1"))


def open_runs(runs: DataFrame) -> DataFrame:
    """A row per cell, for those who need cells in the end."""
    return runs.withColumn("cx", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def overlaps(components: DataFrame, instances: DataFrame, *, key: str = "frame_id") -> DataFrame:
    """Matches between component runs and instance runs with their ``coverage``; lines meet by equality, runs by their ends."""
    area = lambda df, of: df.groupBy(key, of).agg(F.sum(run_length()).alias(f"{of}_area"))
    spans = instances.select(key, "instance", "cy", F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    both = F.least("x1", "_b") - F.greatest("x0", "_a") + 1
    shared = components.join(spans, [key, "cy"]).filter(both > 0).groupBy(key, "component", "instance").agg(F.sum(both).alias("overlap"))
    sized = shared.join(area(components, "component"), [key, "component"]).join(area(instances, "instance"), [key, "instance"])
    matched = (F.col("overlap") / F.col("component_area") >= MIN_COMPONENT_OVERLAP) | (F.col("overlap") / F.col("instance_area") >= MIN_INSTANCE_OVERLAP)
    return sized.filter(matched).withColumn("coverage", F.col("overlap") / F.col("instance_area"))


def union(runs: DataFrame, *, key: str = "frame_id") -> DataFrame:
    """Disjoint runs of all cells covered, adjoining ones joined."""
    line = Window.partitionBy(key, "cy").orderBy("x0", "x1")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.select(key, "cy", "x0", "x1", F.coalesce(F.col("x0") > before + 1, F.lit(True)).cast("long").alias("_opens"))
    numbered = opened.withColumn("_run", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "cy", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def refine(
    cells: DataFrame, instances: DataFrame, *, width: int, height: int, expand: float = 1.08, threshold: float = 0.18,
    min_area: int | None = None, key: str = "frame_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of components that match a target instance, spans of uncovered instances, and counters per frame.

    One checkpoint, of runs and spans; all that follows are joins and sums of them.
    """
    least = max(12, int(width * height * 0.00002)) if min_area is None else min_area
    wanted = cells.join(instances.select(key).distinct(), key, "left_semi")
    none = F.lit(None).cast("long")
    found = component_runs(wanted, least, key=key, height=height).select(key, "cy", "x0", "x1", "component", none.alias("instance"))
    spans = instance_spans(instances, width, height, key=key, expand=expand).select(key, "cy", "x0", "x1", none.alias("component"), "instance")
    held = cut_lineage(found.unionByName(spans))
    components = held.filter("component IS NOT NULL").select(key, "cy", "x0", "x1", "component")
    ellipses = held.filter("component IS NULL").select(key, "cy", "x0", "x1", "instance")
    matches = overlaps(components, ellipses, key=key)
    kept_ids = matches.select(key, "component").distinct()
    best = matches.groupBy(key, "instance").agg(F.max("coverage").alias("coverage"))
    lacking = uncovered_instances(instances, best, threshold, key=key).select(key, "instance")
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    counters = (
        count(instances, "target_instances")
        .join(count(components.select(key, "component").distinct(), "raw_components"), key, "left")
        .join(count(kept_ids, "kept_raw_components"), key, "left")
        .join(count(lacking, "synthetic_instances_added"), key, "left")
        .na.fill(0)
    )
    kept = components.join(kept_ids, [key, "component"], "left_semi").select(key, "cy", "x0", "x1")
    added = ellipses.join(lacking, [key, "instance"], "left_semi").select(key, "cy", "x0", "x1")
    return kept, added, counters
