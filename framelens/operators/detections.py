"""Per-frame ranking and duplicate suppression of detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import Box, bbox_area, bbox_iou, best_face_score, continuity_score, quality_rank
from framelens.operators import ordered
from framelens.session import cut_lineage

FRAME = ("video_id", "frame_index")
DUPLICATE_IOU = 0.72
# Frames with more candidates than this are not collected into one row.
# The thresholds a tracker accepts.
IOU_RANGE = (0.25, 0.95)
CROWDED_FRAME = 2048


def primary_detection(df: DataFrame, width: float, height: float, *, keys: Sequence[str] = FRAME) -> DataFrame:
    """Per frame: the best detection by size, confidence and centrality, and the largest one."""
    box = Box.of()
    first = lambda score: F.struct(score, -F.col("det_id"))
    return df.groupBy(*keys).agg(
        F.max_by("det_id", first(best_face_score(box, F.col("det_score"), width, height))).alias("best_det"),
        F.max_by("det_id", first(bbox_area(box))).alias("largest_det"),
    )


def composition_order(df: DataFrame, *, keys: Sequence[str] = FRAME) -> DataFrame:
    """Adds ``layer``: position by area, smallest first, ties by det_id."""
    area = df.withColumn("_area", bbox_area(Box.of()))
    # Bucketing by a power of two of the area follows the sort order and splits a crowded frame.
    bucket = F.floor(F.log2(F.col("_area") + 1.0) * 4).cast("long")
    return ordered.ordered_index(area, list(keys), ["_area", "det_id"], bucket, "layer").drop("_area")


def ambiguity(
    df: DataFrame, *, margin: float, min_sim: float, max_target_faces: int = 1, keys: Sequence[str] = FRAME,
    similarity: str = "similarity",
) -> DataFrame:
    """Top two similarities per frame and whether they are too close to tell apart.

    The ranking keeps two rows per frame before the shuffle.
    """
    best = Window.partitionBy(*keys).orderBy(F.col(similarity).desc(), "det_id")
    top = (
        df.filter(F.col(similarity).isNotNull()).select(*keys, "det_id", similarity)
        .withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= 2)
    )
    pick = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col(similarity)))
    pair = top.groupBy(*keys).agg(pick(1).alias("top_similarity"), pick(2).alias("second_similarity"))
    if max_target_faces != 1:
        return pair.withColumn("ambiguous", F.lit(False))
    close = (
        (F.col("top_similarity") >= min_sim) & (F.col("second_similarity") >= min_sim)
        & (F.col("top_similarity") - F.col("second_similarity") < margin)
    )
    return pair.withColumn("ambiguous", F.coalesce(close, F.lit(False)))


def with_rank_key(df: DataFrame) -> DataFrame:
    """Adds ``_key``: larger sorts first in suppression: similarity, score, area, then the smaller det_id."""
    return df.withColumn(
        "_key",
        F.struct(
            F.col("similarity").alias("sim"), F.coalesce("det_score", F.lit(0.0)).alias("score"),
            bbox_area(Box.of()).alias("area"), (-F.col("det_id")).alias("first"),
        ),
    )


def held_iou(iou: float) -> float:
    return min(IOU_RANGE[1], max(IOU_RANGE[0], float(iou)))


def nms(
    df: DataFrame, *, iou: float = DUPLICATE_IOU, keys: Sequence[str] = FRAME, crowded: int | None = CROWDED_FRAME,
) -> DataFrame:
    """Greedy duplicate suppression per frame, best first; ``df`` carries ``similarity``.

    A frame's candidates are folded in one row by Catalyst. Frames above ``crowded`` candidates take the
    distributed route of ``crowded_nms``; pass ``crowded=None`` when the detector caps its output.
    ``iou`` is held in ``IOU_RANGE`` on either route.
    """
    iou = held_iou(iou)
    if crowded is None:
        return _folded_nms(df, iou, keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).drop("_n")
    if counts.isEmpty():
        return _folded_nms(df, iou, keys)
    hot = cut_lineage(counts)
    few = _folded_nms(df.join(hot, list(keys), "left_anti"), iou, keys)
    return few.unionByName(crowded_nms(df.join(hot, list(keys), "left_semi"), iou=iou, keys=keys))


def suppress(ranked: Column, iou: float) -> Column:
    """Greedy suppression over an array of boxes, best first."""

    def keep(kept: Column, candidate: Column) -> Column:
        box = Box.in_struct(candidate)
        clash = F.exists(kept, lambda other: bbox_iou(box, Box.in_struct(other)) >= iou)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(candidate)))

    # Without neighbours there is nothing to suppress.
    return F.when(F.size(ranked) <= 1, ranked).otherwise(F.aggregate(ranked, F.slice(ranked, 1, 0), keep))


def _folded_nms(df: DataFrame, iou: float, keys: Sequence[str]) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    ranked = with_rank_key(df)
    item = F.struct(F.col("_key"), *(F.col(c) for c in payload))
    # Lists do not shrink before a shuffle, so plain rows are shuffled and listed after it.
    grouped = ranked.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=False).alias("_all"))

    survivors = suppress(F.col("_all"), iou)
    return grouped.select(*keys, F.explode(survivors).alias("_kept")).select(
        *keys, *(F.col("_kept")[c].alias(c) for c in payload)
    ).select(*df.columns)


def crowded_nms(df: DataFrame, *, iou: float = DUPLICATE_IOU, keys: Sequence[str] = FRAME) -> DataFrame:
    """The same result as the greedy fold, for frames too large for one task.

    Boxes are filed in tiles by their side lengths and upper left corner, such that two boxes can only clash
    if their tiles are near. In each round the best open box of a tile is kept if no tile near it holds a
    better one, and the open boxes it clashes with are dropped; no pairs of open boxes are formed, only
    maxima per tile. Ends when no box is open.
    """
    iou = held_iou(iou)
    keys = list(keys)
    tile = [*keys, "_tw", "_th", "_tx", "_ty"]
    payload = [c for c in df.columns if c not in keys]
    filed = _filed(with_rank_key(df), iou)
    # Empty boxes never clash with anything.
    empty = bbox_area(Box.of()) <= 0
    kept = [filed.filter(empty).select(*df.columns)]
    left = cut_lineage(filed.filter(~empty))
    while not left.isEmpty():
        best = F.max_by(F.struct("_key", *payload), F.col("_key")).alias("_best")
        tops = left.groupBy(*tile).agg(best).select(
            *tile, F.col("_best._key").alias("_key"), *(F.col("_best")[c].alias(c) for c in payload)
        )
        rivals = _tiles_near(tops.select(*tile, "_key"), iou).groupBy(*tile).agg(F.max("_key").alias("_rival"))
        winners = cut_lineage(tops.join(rivals, tile).filter(F.col("_rival") <= F.col("_key")).drop("_rival"))
        kept.append(winners.select(*df.columns))
        cover = _tiles_near(winners.select(*tile, F.struct("x1", "y1", "x2", "y2").alias("_by")), iou)
        clash = bbox_iou(Box.of(), Box.in_struct(F.col("_by"))) >= iou
        dropped = (
            left.select(*tile, "det_id", "x1", "y1", "x2", "y2").join(cover, tile).filter(clash)
            .select(*keys, "det_id").distinct()
        )
        left = cut_lineage(left.join(dropped, [*keys, "det_id"], "left_anti"))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def _tile_size(level: Column, iou: float) -> Column:
    """Two boxes with that IoU have sides within a factor 1/iou, so levels differ by at most one, and their
    corners lie at most (1 - iou) / iou of the smaller side apart, which is at most one tile."""
    return F.pow(F.lit(1.0 / iou), level + 1) * ((1.0 - iou) / iou)


def _filed(df: DataFrame, iou: float) -> DataFrame:
    side = lambda low, high: F.greatest(F.col(high) - F.col(low), F.lit(1e-9))
    level = lambda length: F.floor(F.log(length) / F.log(F.lit(1.0 / iou)))
    place = lambda at, lv: F.floor(F.col(at) / _tile_size(F.col(lv), iou))
    return df.withColumns({"_tw": level(side("x1", "x2")), "_th": level(side("y1", "y2"))}).withColumns(
        {"_tx": place("x1", "_tw"), "_ty": place("y1", "_th")}
    )


def _tiles_near(df: DataFrame, iou: float) -> DataFrame:
    """Repeat each row for every tile that may hold a box clashing with one of its own tile."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    wide = df.withColumns({"_lw": F.explode(steps)}).withColumns({"_lh": F.explode(steps)})

    def span(level: str, at: str, step: str) -> Column:
        size, other = _tile_size(F.col(level), iou), _tile_size(F.col(level) + F.col(step), iou)
        # Corners are compared across tile sizes, so one more tile on either side absorbs rounding.
        first, last = F.floor(F.col(at) * size / other) - 1, F.floor((F.col(at) + 1) * size / other) + 1
        return F.explode(F.sequence(first, last))

    return (
        wide.withColumns({"_nx": span("_tw", "_tx", "_lw")}).withColumns({"_ny": span("_th", "_ty", "_lh")})
        .withColumns(
            {"_tw": F.col("_tw") + F.col("_lw"), "_th": F.col("_th") + F.col("_lh"), "_tx": F.col("_nx"), "_ty": F.col("_ny")}
        )
        .drop("_lw", "_lh", "_nx", "_ny")
    )


def recognition_candidates(
    detections: DataFrame, active: DataFrame | None, *, max_faces: int = 10, max_candidates: int = 1,
    width: float, height: float, keys: Sequence[str] = FRAME,
) -> DataFrame:
    """Detections worth recognising in each frame; adds ``pick``, their order.

    ``active`` holds per frame ``full_scan`` and ``tracks``, the boxes of the running tracks in track order.
    Best ``max_faces`` by quality survive (cut before the shuffle); unless the frame is a full scan each track
    first reserves the nearest free detection, and the rest of the limit is filled by quality.
    """
    keys = list(keys)
    by_quality = Window.partitionBy(*keys).orderBy(quality_rank(Box.of(), F.col("det_score")).desc(), "det_id")
    faces = detections.withColumn("_rank", F.row_number().over(by_quality)).filter(F.col("_rank") <= max_faces)
    if active is None:
        return faces.withColumnRenamed("_rank", "pick")
    listed = faces.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("_rank"), F.col("det_id"), "x1", "y1", "x2", "y2"))
        ).alias("_faces")
    ).join(active, keys, "left")
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    tracks = F.coalesce(F.filter("tracks", lambda track: track.isNotNull()), none)  # a null is no track and reserves nothing
    plain = F.coalesce(F.col("full_scan"), F.lit(False)) | (F.size(tracks) == 0)
    limit = F.least(F.lit(max_faces), F.greatest(F.lit(max_candidates), F.size(tracks)))

    def reserve(used: Column, track: Column) -> Column:
        free = F.filter("_faces", lambda face: ~F.array_contains(used, face["_rank"]))
        scored = F.transform(
            free,
            lambda face: F.struct(
                (-continuity_score(Box.in_struct(face), Box.in_struct(track), width, height)).alias("cost"),
                face["_rank"].alias("rank"),
            ),
        )
        room = (F.size(free) > 0) & (F.size(used) < limit)
        return F.when(room, F.concat(used, F.array(F.array_min(scored)["rank"]))).otherwise(used)

    reserved = F.aggregate(tracks, F.array().cast("array<int>"), reserve)
    ranks = F.transform("_faces", lambda face: face["_rank"])
    filled = F.slice(F.concat(reserved, F.array_except(ranks, reserved)), 1, limit)
    chosen = listed.select(*keys, F.posexplode(F.when(plain, ranks).otherwise(filled)).alias("_pos", "_rank"))
    return faces.join(chosen, [*keys, "_rank"]).withColumn("pick", F.col("_pos") + 1).drop("_pos", "_rank")
