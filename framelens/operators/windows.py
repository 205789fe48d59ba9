"""Planning, expanding and stitching of overlapping windows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framelens.functions import crossfade_weight, window_seed
from framelens.operators import ordered
from framelens.session import cut_lineage

#: Frames of a video that one task plans; longer videos are planned in pieces.
PIECE_FRAMES = 16_384
#: Frames of a bin in which windows and frames meet; a usual window reaches two.
BIN_FRAMES = 64


@dataclass(frozen=True)
class WindowPlan:
    frame_num: int = 49
    overlap: int = 17
    snap: int = 12
    seed: int = 100
    seed_mode: str = "absolute_frame"
    chunking: bool = True
    scene_aware: bool = True

    def __post_init__(self) -> None:
        if self.frame_num < 5 or self.frame_num % 4 != 1:
            raise ValueError("frame_num must have the form 4n+1 and be at least 5")
        if not 0 <= self.overlap < self.frame_num:
            raise ValueError("overlap must lie between 0 and frame_num - 1")

    @property
    def stride(self) -> int:
        return self.frame_num - self.overlap


def clean_cuts(cuts: Column, n: Column) -> Column:
    """Distinct cut positions strictly inside a video, ascending."""
    return F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c > 0) & (c < n))))


def plan_windows(
    videos: DataFrame, cuts: DataFrame | None = None, plan: WindowPlan = WindowPlan(), *, key: str = "video_id",
    piece_frames: int = PIECE_FRAMES,
) -> DataFrame:
    """Window rows (clip_index, start_frame, valid_frames, overlap_before, hard_cut_before, seed) per video.

    Without cuts the starts are an arithmetic sequence. With cuts each start depends on the one before. Videos are cut into
    pieces of ``piece_frames``, and a piece sees only the cuts its starts can reach. A step is shorter than a window, so a
    plan enters a piece at one of its first few frames: every piece of a long video tabulates, for each of these, where
    the plan leaves it and after how many windows. The tables, one short row a piece, are followed along the video; then all
    pieces place their windows at once.
    """
    n = F.col("requested_frames")
    problem = F.when(n <= 0, F.lit("requested_frames must be positive"))
    if not plan.chunking:
        problem = problem.when(
            n > plan.frame_num, F.lit("the video is longer than one window and chunking is off")
        )
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("long")).otherwise(n.cast("long"))
    headers = videos.select(key, checked.alias("n"))
    if cuts is None or not plan.scene_aware or not plan.chunking:
        return _regular_windows(headers, plan, key)
    key_type = videos.schema[key].dataType.simpleString()
    size = max(piece_frames, plan.frame_num)
    last = F.floor((F.greatest("n", F.lit(1)) - 1) / size).cast("long")
    heads = headers.select(key, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"), "n")
    pos = F.col("cut").cast("long")
    seen_from = F.sequence(F.floor(F.greatest(F.lit(0), pos - plan.frame_num + 1) / size).cast("long"), F.floor((pos - 1) / size).cast("long"))
    marks = cuts.filter(pos > 0).select(key, F.explode(seen_from).alias("piece"), pos.alias("pos"))
    start = heads.withColumns({"entry": F.lit(0).cast("long"), "clip": F.lit(0).cast("long")})
    if not videos.filter(n > size).limit(1).isEmpty():
        in_pieces = headers.filter(F.col("n") > size).select(F.col(key).alias(f"_of_{key}"))
        long = start.filter(F.col("n") > size)
        entries = _entries(_crossings(long, ordered.join_null_safe(marks, in_pieces, [key], "left_semi"), plan, size, key, key_type), key, key_type)
        entries = entries.withColumnsRenamed({c: f"_of_{c}" for c in (key, "piece")})
        start = start.filter(F.col("n") <= size).unionByName(ordered.join_null_safe(heads.filter(F.col("n") > size), entries, [key, "piece"]))

    def windows(video, piece, n, entry, clip, near):
        here, stop = piece * size + entry, (piece + 1) * size
        if not piece:
            yield video, 0, 0, min(plan.frame_num, n), 0, False
        while here < stop and here + plan.frame_num < n:
            following, hard = _next_start(here, near, n, plan)
            clip += 1
            yield video, clip, following, min(plan.frame_num, n - following), max(0, here + plan.frame_num - following), hard
            here = following

    placed = _by_piece(
        start, marks, key, windows,
        f"`{key}` {key_type}, clip_index long, start_frame long, valid_frames long, overlap_before long, hard_cut_before boolean",
    )
    return placed.withColumn("seed", window_seed(F.col("start_frame"), plan.seed, plan.seed_mode))


def _by_piece(heads: DataFrame, marks: DataFrame, key: str, made, schema: str) -> DataFrame:
    """Rows that ``made`` yields from each piece: video, piece, length, entry, clip and the cuts in reach, ascending.

    Heads and cuts meet in one aggregate; a piece has no more distinct cuts than frames.
    """
    none = F.lit(None).cast("long")
    rows = heads.withColumn("pos", none).unionByName(marks.withColumns({"n": none, "entry": none, "clip": none}))
    pieces = rows.groupBy(key, "piece").agg(
        *(F.max(c).alias(c) for c in ("n", "entry", "clip")), F.sort_array(F.collect_set("pos")).alias("near")
    ).filter(F.col("n").isNotNull())
    made_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for piece in zip(*(c.to_pylist() for c in batch.columns)) for row in made(*piece)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made_schema)], schema=made_schema)

    return pieces.mapInArrow(run, schema)


def _next_start(here: int, cuts: list[int], n: int, plan: WindowPlan) -> tuple[int, bool]:
    """The start after ``here``: the cut nearest to a stride ahead, the earlier on ties, if one is near; else the stride."""
    wanted = here + plan.stride
    low, high = max(here + 1, wanted - plan.snap), min(n - 1, here + plan.frame_num - 1, wanted + plan.snap)
    near = cuts[bisect_left(cuts, low) : bisect_right(cuts, high)]
    return (min(near, key=lambda c: (abs(c - wanted), c)), True) if near else (wanted, False)


def _crossings(heads: DataFrame, marks: DataFrame, plan: WindowPlan, size: int, key: str, key_type: str) -> DataFrame:
    """Per piece and entry frame: the frame of the next piece the plan enters (-1 if it ends here), and windows placed."""

    def table(video, piece, n, entry, clip, near):
        first, stop, known = piece * size, (piece + 1) * size, {}
        entries = range(first, first + min(plan.frame_num, n - first))
        for start in entries:
            path, here = [], start
            while here < stop and here not in known and here + plan.frame_num < n:
                path.append(here)
                here = _next_start(here, near, n, plan)[0]
            leave, placed = known[here] if here in known else (here - stop if here >= stop else -1, 0)
            for step in reversed(path):
                placed += 1
                known[step] = leave, placed
            known.setdefault(start, (leave, placed))
        yield video, piece, [known[e][0] for e in entries], [known[e][1] for e in entries]

    return _by_piece(heads, marks, key, table, f"`{key}` {key_type}, piece long, leaves array<long>, placed array<long>")


def _entries(crossings: DataFrame, key: str, key_type: str) -> DataFrame:
    """Where the plan enters each piece it reaches, and the index of the window that does: (key, piece, entry, clip)."""

    def step(state, row):
        piece, leaves, placed = row
        video, entry, clip = state
        if entry < 0:
            return ()
        state[1:] = [leaves[entry], clip + placed[entry]]
        return ((video, piece, entry, clip),)

    return ordered.fold_sorted(
        crossings, [key], ["piece"], ["piece", "leaves", "placed"], lambda k: [k[0], 0, 0], step, f"`{key}` {key_type}, piece long, entry long, clip long"
    )


def _regular_windows(headers: DataFrame, plan: WindowPlan, key: str) -> DataFrame:
    last = F.ceil(F.greatest(F.lit(0), F.col("n") - plan.frame_num) / F.lit(plan.stride))
    start = F.col("clip_index") * plan.stride
    return (
        headers.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("clip_index"))
        .withColumn("start_frame", start)
        .select(
            key, "clip_index", "start_frame",
            F.least(F.lit(plan.frame_num).cast("long"), F.col("n") - F.col("start_frame")).alias("valid_frames"),
            F.when(F.col("clip_index") == 0, 0).otherwise(plan.overlap).cast("long").alias("overlap_before"),
            F.lit(False).alias("hard_cut_before"),
            window_seed(F.col("start_frame"), plan.seed, plan.seed_mode).alias("seed"),
        )
    )


def overlap_before(clips: DataFrame, *, key: str = "video_id", name: str = "overlap_before") -> DataFrame:
    """Frames each window shares with the one before it."""
    end = F.col("start_frame") + F.col("valid_frames")
    lagged = ordered.ordered_lag(
        clips, [key], "clip_index", ordered.frame_bucket("clip_index"), {"_end": end}
    )
    shared = F.greatest(F.lit(0).cast("long"), F.col("_end") - F.col("start_frame"))
    return lagged.withColumn(name, F.coalesce(shared, F.lit(0).cast("long"))).drop("_end")


def clip_plan_stats(clips: DataFrame, videos: DataFrame, plan: WindowPlan = WindowPlan(), *, key: str = "video_id"):
    per_video = clips.groupBy(key).agg(
        F.count(F.lit(1)).alias("clip_count"), F.sum("valid_frames").alias("valid_window_frames")
    )
    zero = F.lit(0).cast("long")
    generated = F.col("clip_count") * plan.frame_num
    return per_video.join(videos.select(key, "requested_frames"), key).select(
        key, "clip_count", generated.alias("generated_frames"), "valid_window_frames",
        F.greatest(zero, F.col("valid_window_frames") - F.col("requested_frames")).alias("duplicated_overlap_frames"),
        F.greatest(zero, generated - F.col("valid_window_frames")).alias("padded_window_frames"),
    )


def clip_frame_index(clips: DataFrame) -> DataFrame:
    """One row per window and frame: the interval join, opened up so that it becomes an equality join."""
    offsets = F.sequence(F.lit(0).cast("long"), F.col("valid_frames") - 1)
    return clips.select("*", F.explode(offsets).alias("offset")).withColumn(
        "frame_index", F.col("start_frame") + F.col("offset")
    )


def in_bins(clips: DataFrame, frames: DataFrame, *, key: str = "video_id") -> DataFrame:
    """Pairs of a window and a frame in it. Windows are filed in the bins of ``BIN_FRAMES`` frames they reach, frames in their
    own, so what is shuffled are windows and frames, not a row per window and frame; each pair meets in one bin."""
    own = lambda at: F.floor(at / BIN_FRAMES).cast("long")
    last = F.col("start_frame") + F.col("valid_frames") - 1
    filed = clips.filter(F.col("valid_frames") > 0).withColumn("_bin", F.explode(F.sequence(own(F.col("start_frame")), own(last))))
    placed = frames.withColumn("_bin", own(F.col("frame_index")))
    met = filed.hint("merge").join(placed, [key, "_bin"])
    return met.filter((F.col("frame_index") >= F.col("start_frame")) & (F.col("frame_index") <= last)).drop("_bin")


def clip_frames(clips: DataFrame, frames: DataFrame, *, key: str = "video_id") -> DataFrame:
    return in_bins(clips, frames, key=key).withColumn("offset", F.col("frame_index") - F.col("start_frame"))


def pad_to_length(clip_values: DataFrame, n: int, *, keys=("video_id", "clip_index"), value: str = "value"):
    """Exactly offsets 0 … n-1 per clip; a short clip repeats its last value."""
    kept = clip_values.filter(F.col("offset") < n).select(*keys, "offset", value)
    tails = clip_values.groupBy(*keys).agg(F.max("offset").alias("_last"), F.max_by(value, "offset").alias(value))
    padding = tails.filter(F.col("_last") < n - 1).select(
        *keys, F.explode(F.sequence(F.col("_last") + 1, F.lit(n - 1).cast("long"))).alias("offset"), value
    )
    return kept.unionByName(padding)


def nearest_cut(clips: DataFrame, cuts: DataFrame, window: int, *, key: str = "video_id") -> DataFrame:
    """The cut closest to each clip's start within ``window`` frames, the smaller on ties; null when none.

    Starts and cuts meet in cells one window wide, so the range join is an equality join on (video, cell).
    """
    size = max(1, int(window))
    cell = lambda c: F.floor(c / size).cast("long")
    start = F.col("start_frame")
    cells = F.array_distinct(F.array(cell(start - window), cell(start), cell(start + window)))
    probes = clips.select(key, "clip_index", "start_frame", F.explode(cells).alias("_cell"))
    targets = cuts.select(key, F.col("cut").cast("long").alias("cut"), cell(F.col("cut")).alias("_cell"))
    gap = F.abs(F.col("cut") - F.col("start_frame"))
    best = (
        probes.hint("merge").join(targets, [key, "_cell"]).filter(gap <= window)
        .groupBy(key, "clip_index")
        .agg(F.min_by("cut", F.struct(gap, F.col("cut"))).alias("nearest_cut"))
    )
    return clips.join(best, [key, "clip_index"], "left")


def _planned_reach(plan: WindowPlan) -> int:
    """A window reaches at most frame_num frames and starts at least stride - snap (or one) frames after the
    one before it, so only so many later windows can cover a frame of it."""
    step = max(1, plan.stride - (plan.snap if plan.scene_aware else 0))
    return -(-plan.frame_num // step)


def _reach(clips: DataFrame, key: str) -> int:
    """The same bound from the windows: most of them that start within the length of the longest one.

    Counted stretch by stretch: a window also looks on from the stretches that its start is in reach of.
    """
    longest = clips.agg(F.max("valid_frames").alias("n")).first()["n"]
    if not longest:
        return 0
    size, start = max(int(longest), ordered.FRAMES_PER_BUCKET), F.col("start_frame")
    own = F.floor(start / size).cast("long")
    seen = F.sequence(F.floor((start - longest + 1) / size).cast("long"), own)
    placed = clips.select(key, "start_frame", own.alias("_own"), F.explode(seen).alias("_seen"))
    ahead = Window.partitionBy(key, "_seen").orderBy("start_frame").rangeBetween(0, int(longest) - 1)
    near = placed.withColumn("n", F.count(F.lit(1)).over(ahead) - 1).filter(F.col("_own") == F.col("_seen"))
    return near.agg(F.max("n").alias("n")).first()["n"]


def stitch(
    clip_values: DataFrame, clips: DataFrame, plan: WindowPlan | None = None, *, key: str = "video_id"
) -> DataFrame:
    """One value per frame of the output.

    ``plan``, if given, must be the one the clips were planned by; else the clips are asked how far they reach.

    A soft boundary cross-fades with what is already there; after a hard cut the later window owns its
    frames. Laying windows over each other in order is linear in their values, so each value gets its final
    share from the windows that follow it and the frames are plain sums, combined before the shuffle.
    """
    if plan is None:  # the windows are written once, then asked and used
        clips = cut_lineage(clips)
    reach = _reach(clips, key) if plan is None else _planned_reach(plan)
    details = ("start_frame", "overlap_before", "hard_cut_before")
    turned = clips.select(
        key, F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_ahead"), "clip_index", "valid_frames", *details
    ).select(key, (F.col("clip_index") - F.col("_ahead")).alias("clip_index"), "_ahead", "valid_frames", *details)
    at = lambda i, c: F.max(F.when(F.col("_ahead") == i, F.col(c))).alias(c if i == 0 else f"_{c}_{i}")
    layered = turned.groupBy(key, "clip_index").agg(
        at(0, "valid_frames"), *(at(i, c) for i in range(reach + 1) for c in details)
    ).filter(F.col("start_frame").isNotNull())
    # Size estimates do not see through an explode upstream, so the join is not left to them: the windows
    # are a small part of the values, and each task hashes its share of them.
    placed = clip_values.join(layered.hint("shuffle_hash"), [key, "clip_index"]).filter(F.col("offset") < F.col("valid_frames"))
    frame = F.col("frame_index")

    def taken(start: Column, overlap: Column, hard: Column) -> Column:
        """Share a window takes of a frame it covers, from whatever lies below."""
        return F.when(hard | (frame - start >= overlap), F.lit(1.0)).otherwise(crossfade_weight(frame - start, overlap))

    share = F.when(F.col("clip_index") == 0, F.lit(1.0)).otherwise(taken(*(F.col(c) for c in details)))
    covered = F.lit(False)
    for i in range(1, reach + 1):
        later = [F.col(f"_{c}_{i}") for c in details]
        above = F.coalesce(later[0] <= frame, F.lit(False))
        covered = covered | above
        share = share * F.when(above, F.lit(1.0) - taken(*later)).otherwise(F.lit(1.0))
    opens = (F.col("clip_index") > 0) & (F.col("offset") == 0) & (
        F.col("hard_cut_before") | (F.col("overlap_before") > 0)
    )
    return (
        placed.withColumn("frame_index", F.col("start_frame") + F.col("offset"))
        .select(key, "frame_index", (F.col("value") * share).alias("_part"), (opens & ~covered).alias("_opens"))
        .groupBy(key, "frame_index")
        .agg(F.sum("_part").alias("value"), F.count(F.lit(1)).alias("layers"), F.max("_opens").alias("boundary"))
    )
