"""Sparse cell tables: masks, components, histograms and value statistics.

A cell row is (frame_id, cx, cy, v). Cells of one frame are distinct positions, so a frame has at most
width x height of them and a row or column of a frame at most width or height.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.session import bounded, cut_lineage

FOREGROUND = 24
MIN_COMPONENT_OVERLAP, MIN_INSTANCE_OVERLAP = 0.05, 0.08
ROW_STRIDE = 2**31
# Cells of one frame that one task may hold; an 8K frame has twice as many.
TASK_CELLS = 16_000_000


def union_masks(cells: DataFrame, *, keys: Sequence[str] = ("frame_id",), value: str = "v") -> DataFrame:
    """Largest value per cell over all instances."""
    return cells.groupBy(*keys, "cx", "cy").agg(F.max(value).alias(value))


def mask_area(cells: DataFrame, *, keys: Sequence[str] = ("frame_id",), value: str = "v", above: int = 0):
    return cells.filter(F.col(value) > above).groupBy(*keys).agg(F.count(F.lit(1)).alias("area"))


def histogram32(cells: DataFrame, *, keys: Sequence[str] = ("frame_id",), value: str = "v", bins: int = 32):
    """Array of ``bins`` equal counts over [0, 256): conditional counts, combined before one shuffle."""
    slot = F.floor(F.col(value) / F.lit(256 // bins))
    counts = cells.groupBy(*keys).agg(*(F.count(F.when(slot == i, 1)).alias(f"_b{i}") for i in range(bins)))
    return counts.select(*keys, F.array(*(F.col(f"_b{i}") for i in range(bins))).alias("hist"))


def pixel_stats(
    cells: DataFrame, *, key: str = "frame_id", value: str = "v", dark: int = 5, bright: int = 250
) -> DataFrame:
    """Mean, variance of the four-neighbour Laplacian (border mirrored without its edge), clipped share.

    Both directions reuse one shuffle by frame. A neighbour is the cell one step away; where it is missing, as
    at the border or in a hole, the one opposite stands for it.
    """
    v = F.col(value).cast("double")
    placed = cells.select(key, "cx", "cy", v.alias("_v")).repartition(key)
    along = lambda line, at: Window.partitionBy(key, line).orderBy(at)

    def second_difference(line: str, at: str) -> Column:
        w = along(line, at)
        before = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag("_v").over(w))
        after = F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead("_v").over(w))
        inner = F.coalesce(before, after, F.col("_v")) + F.coalesce(after, before, F.col("_v"))
        return inner - 2.0 * F.col("_v")

    laplacian = placed.withColumn("_dx", second_difference("cy", "cx")).withColumn("_dy", second_difference("cx", "cy"))
    clipped = (F.col("_v") <= dark) | (F.col("_v") >= bright)
    return laplacian.groupBy(key).agg(
        F.avg("_v").alias("mean"), F.var_pop(F.col("_dx") + F.col("_dy")).alias("sharpness_var"),
        F.avg(F.when(clipped, 1.0).otherwise(0.0)).alias("clipped_fraction"),
    )


def component_cells(
    cells: DataFrame, *, key: str = "frame_id", value: str = "v", threshold: int = FOREGROUND,
    max_cells: int | None = None,
) -> DataFrame:
    """Foreground cells with ``component``: the smallest cell number (cy * 2^31 + cx) of their 8-connected part.

    A frame's cells are distinct positions, so frames up to ``TASK_CELLS`` cells are labelled whole, one frame
    at a time. ``max_cells`` (width x height) states the bound when it is known; otherwise frames are counted,
    and larger ones are labelled across tasks.
    """
    front = cells.filter(F.col(value) >= threshold)
    if max_cells is not None and max_cells <= TASK_CELLS:
        return _label_frames(front, key)
    large = front.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TASK_CELLS).drop("_n")
    if large.isEmpty():
        return _label_frames(front, key)
    large = cut_lineage(large)
    return _label_frames(front.join(large, key, "left_anti"), key).unionByName(
        spread_labels(front.join(large, key, "left_semi"), key=key)
    )


def _label_frames(front: DataFrame, key: str) -> DataFrame:
    """Label whole frames as they stream by in (frame, row, column) order; a task holds one frame and a batch."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in front.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def labelled(parts):
            rows = pd.concat(parts, ignore_index=True)
            return rows.assign(component=_components(*(rows[c].to_numpy() for c in (key, "cy", "cx"))))

        for batch in batches:
            frames = batch[key].to_numpy()
            if not len(frames):
                continue
            # The last frame may go on in the next batch.
            others = np.flatnonzero(frames != frames[-1])
            split = int(others[-1]) + 1 if len(others) else 0
            if split or (held and held[-1][key].iloc[-1] != frames[0]):
                yield labelled([*held, batch.iloc[:split]])
                held = []
            held.append(batch.iloc[split:])
        if held:
            yield labelled(held)

    arranged = front.repartition(key).sortWithinPartitions(key, "cy", "cx")
    return arranged.mapInPandas(run, f"{ddl}, component long")


def _components(frames: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Smallest cell number of each cell's part."""
    first, last, parts = run_parts(frames, ys, xs)
    return np.repeat(parts, last - first + 1)


def run_parts(frames: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last cell of every horizontal run, and the smallest cell number of its part: runs join those they touch above."""
    breaks = np.flatnonzero((frames[1:] != frames[:-1]) | (np.diff(ys) != 0) | (np.diff(xs) != 1)) + 1
    first = np.concatenate(([0], breaks))
    last = np.concatenate((breaks, [len(xs)])) - 1
    order = np.concatenate(([0], np.cumsum(frames[1:] != frames[:-1])))[first].tolist()
    row, left, right = ys[first].tolist(), xs[first].tolist(), xs[last].tolist()
    parent = list(range(len(first)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0
    for i in range(len(first)):
        line = (order[i], row[i] - 1)
        while above < i and ((order[above], row[above]) < line or (
            (order[above], row[above]) == line and right[above] < left[i] - 1
        )):
            above += 1
        j = above
        while j < i and (order[j], row[j]) == line and left[j] <= right[i] + 1:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
            j += 1
    # Runs are in cell order, so the smallest run of a part starts with its smallest cell.
    roots = np.array([root(i) for i in range(len(first))])
    names = ys[first].astype(np.int64) * ROW_STRIDE + xs[first]
    return first, last, names[roots]


def spread_labels(front: DataFrame, *, key: str = "frame_id") -> DataFrame:
    """The same labels for frames too large for one task.

    Cells are first joined to horizontal runs; labels then spread over touching runs, with path halving, until
    nothing changes. Each round is checkpointed.
    """
    line = Window.partitionBy(key, "cy").orderBy("cx")
    grouped = front.withColumn("_g", F.col("cx") - F.row_number().over(line))
    start = F.min("cx").over(Window.partitionBy(key, "cy", "_g"))
    marked = grouped.withColumn("_run", (F.col("cy") * ROW_STRIDE + start).cast("long")).drop("_g")
    marked = cut_lineage(marked)
    runs = marked.groupBy(key, "cy", "_run").agg(F.min("cx").alias("a"), F.max("cx").alias("b"))
    below = runs.select(
        key, (F.col("cy") - 1).alias("cy"), F.col("_run").alias("_other"), F.col("a").alias("a2"), F.col("b").alias("b2")
    )
    touching = runs.join(below, [key, "cy"]).filter(
        (F.col("a2") <= F.col("b") + 1) & (F.col("b2") >= F.col("a") - 1)
    )
    edges = touching.select(key, F.col("_run").alias("src"), F.col("_other").alias("dst"))
    edges = cut_lineage(edges.unionByName(edges.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = runs.select(key, F.col("_run").alias("node"), F.col("_run").alias("label"))
    while True:
        spread = (
            edges.join(labels.select(key, F.col("node").alias("dst"), "label"), [key, "dst"])
            .groupBy(key, F.col("src").alias("node")).agg(F.min("label").alias("_near"))
        )
        lower = labels.join(spread, [key, "node"], "left").select(
            key, "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("label")
        )
        hop = lower.select(key, F.col("node").alias("label"), F.col("label").alias("_hop"))
        jumped = lower.join(hop, [key, "label"], "left").select(
            key, "node", "_old", F.least("label", F.coalesce("_hop", "label")).alias("label")
        )
        jumped = cut_lineage(jumped)
        labels = jumped.drop("_old")
        if jumped.filter(F.col("label") != F.col("_old")).isEmpty():
            break
    return marked.join(
        labels.select(key, F.col("node").alias("_run"), F.col("label").alias("component")), [key, "_run"]
    ).drop("_run")


def component_label(
    cells: DataFrame, min_area: int = 12, *, key: str = "frame_id", value: str = "v", threshold: int = FOREGROUND,
    max_cells: int | None = None,
) -> DataFrame:
    """Cells of components with at least ``min_area`` cells, with ``component`` and ``area``."""
    labelled = component_cells(cells, key=key, value=value, threshold=threshold, max_cells=max_cells)
    sizes = labelled.groupBy(key, "component").agg(F.count(F.lit(1)).alias("area")).filter(F.col("area") >= min_area)
    return labelled.join(sizes, [key, "component"])


def box_instance_overlap(components: DataFrame, instances: DataFrame, *, key: str = "frame_id") -> DataFrame:
    """Matches between component cells and instance cells.

    ``components``: (frame_id, component, cx, cy); ``instances``: (frame_id, instance, cx, cy). Only cells both
    cover are paired, so the work follows the shared area.
    """
    area_c = components.groupBy(key, "component").agg(F.count(F.lit(1)).alias("component_area"))
    area_i = instances.groupBy(key, "instance").agg(F.count(F.lit(1)).alias("instance_area"))
    shared = (
        components.select(key, "component", "cx", "cy").join(instances.select(key, "instance", "cx", "cy"), [key, "cx", "cy"])
        .groupBy(key, "component", "instance").agg(F.count(F.lit(1)).alias("overlap"))
    )
    sized = shared.join(area_c, [key, "component"]).join(area_i, [key, "instance"])
    matched = (F.col("overlap") / F.col("component_area") >= MIN_COMPONENT_OVERLAP) | (
        F.col("overlap") / F.col("instance_area") >= MIN_INSTANCE_OVERLAP
    )
    return sized.filter(matched).withColumn("coverage", F.col("overlap") / F.col("instance_area"))


def instance_coverage(matches: DataFrame, *, key: str = "frame_id") -> DataFrame:
    return matches.groupBy(key, "instance").agg(F.max("coverage").alias("coverage"))


def uncovered_instances(
    instances: DataFrame, coverage: DataFrame, threshold: float = 0.18, *, key: str = "frame_id"
) -> DataFrame:
    """Instances whose best coverage stays below the threshold (held within 0.02 … 0.95)."""
    limit = min(0.95, max(0.02, float(threshold)))
    best = F.coalesce(F.col("coverage"), F.lit(0.0))
    return instances.join(coverage, [key, "instance"], "left").withColumn("coverage", best).filter(best < limit)


def instance_cells(instances: DataFrame, width: int, height: int, *, key: str = "frame_id", expand: float = 1.08):
    """Cells inside each instance's oriented ellipse, within the frame."""
    from framelens.operators.runs import instance_spans, open_runs

    return open_runs(instance_spans(instances, width, height, key=key, expand=expand)).select(key, "instance", "cx", "cy")


def refine_regions(
    cells: DataFrame, instances: DataFrame, *, width: int, height: int, expand: float = 1.08,
    threshold: float = 0.18, min_area: int | None = None, key: str = "frame_id",
) -> tuple[DataFrame, DataFrame]:
    """Keep mask components that match a target instance, add ellipses for uncovered instances.

    Returns (cells, counters per frame). Frames that are ambiguous or empty carry no instance rows and
    produce no cells. All decisions are made on runs (``runs.refine``); only the result is opened into cells.
    """
    from framelens.operators.runs import open_runs, refine

    kept, added, counters = refine(
        cells, instances, width=width, height=height, expand=expand, threshold=threshold, min_area=min_area, key=key
    )
    kept = cells.select(key, "cx", "cy", F.col("v").cast("int").alias("v")).join(open_runs(kept).select(key, "cx", "cy"), [key, "cx", "cy"])
    added = open_runs(added).select(key, "cx", "cy", F.lit(255).alias("v"))
    return union_masks(kept.unionByName(added), keys=[key]), counters


def mask_stats(counters: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Totals over per-frame counters."""
    n = F.col("target_instances")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    with_target = F.count(F.when(n > 0, 1))
    return counters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_total"), with_target.alias("frames_with_target"),
        F.count(F.when(n > 1, 1)).alias("frames_with_multiple_targets"),
        F.count(F.when(n <= 0, 1)).alias("frames_without_target"), total("target_instances").alias("target_instances"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_target_instances"),
        F.when(with_target > 0, total("target_instances") / with_target).otherwise(F.lit(0.0)).alias(
            "average_target_instances"
        ),
        total("raw_components").alias("raw_components"), total("kept_raw_components").alias("kept_raw_components"),
        F.greatest(F.lit(0).cast("long"), total("raw_components") - total("kept_raw_components")).alias(
            "dropped_raw_components"
        ),
        total("synthetic_instances_added").alias("synthetic_instances_added"),
    )


def _moments(df: DataFrame, value: str, group: str, target) -> DataFrame:
    """Group moments plus the target group's own, one row per group."""
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    of_target = stats.filter(F.col(group) == target).select(
        F.lit(1).alias("_one"), F.col("_n").alias("_tn"), F.col("_mean").alias("_tmean"), F.col("_std").alias("_tstd")
    )
    return bounded(stats.withColumn("_one", F.lit(1)).join(of_target, "_one").drop("_one"))


def moment_match(
    df: DataFrame, value: str, group: str, target, *, min_rows: int = 128, name: str = "matched"
) -> DataFrame:
    """Shift and scale each group's values to the target group's mean and spread.

    The spread ratio is held in 0.72 … 1.38, spreads in at least 3, results in 0 … 255; groups below
    ``min_rows`` stay as they are.
    """
    v = F.col(value)
    floor = lambda c: F.greatest(F.col(c), F.lit(3.0))
    ratio = F.least(F.lit(1.38), F.greatest(F.lit(0.72), floor("_tstd") / floor("_std")))
    moved = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - F.col("_mean")) * ratio + F.col("_tmean")))
    joined = df.join(_moments(df, value, group, target), group)
    return joined.withColumn(name, F.when(F.col("_n") < min_rows, v).otherwise(moved)).select(*df.columns, name)


def moment_match_strength(
    df: DataFrame, value: str, group: str, target, strength: float, *, name: str = "matched"
) -> DataFrame:
    """Unclipped ratio, results in 0 … 255, then mixed with the input by ``strength`` in 0 … 1."""
    v, eps, mix = F.col(value), 1e-6, min(1.0, max(0.0, float(strength)))
    moved = (v - F.col("_mean")) * ((F.col("_tstd") + eps) / (F.col("_std") + eps)) + F.col("_tmean")
    held = F.least(F.lit(255.0), F.greatest(F.lit(0.0), moved))
    joined = df.join(_moments(df, value, group, target), group)
    return joined.withColumn(name, held * mix + v * (1.0 - mix)).select(*df.columns, name)
