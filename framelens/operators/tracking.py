"""Multi-instance tracking over frames."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import Box, as_doubles, bbox_area, pose_from_kps
from framelens.functions.boxes import (
    ASSOCIATION_CONTINUITY_WEIGHT,
    ASSOCIATION_GATE,
    ASSOCIATION_IOU_WEIGHT,
    ASSOCIATION_PROXIMITY_WEIGHT,
    ASSOCIATION_SIMILARITY_WEIGHT,
    Affine,
    target_score,
    valid_affine,
)
from framelens.operators import detections as det
from framelens.operators import filters, ordered, sequence
from framelens.operators.ordered import frame_bucket
from framelens.session import bounded, cut_lineage

# Frames one fold takes at most; longer segments are folded in pieces of this length.
CHUNK_FRAMES = 16_384
# Track ids are frame * IDS_PER_FRAME + rank; more tracks cannot begin in a frame.
IDS_PER_FRAME = 1 << 16
POINT = "struct<x:double,y:double>"
CANDIDATE = (
    f"struct<similarity:double,det_id:bigint,x1:double,y1:double,x2:double,y2:double,kps:array<{POINT}>>"
)
CANDIDATE_FIELDS = ("similarity", "det_id", "x1", "y1", "x2", "y2", "kps")
INSTANCE = (
    f"struct<track_id:bigint,det_id:bigint,x1:double,y1:double,x2:double,y2:double,kps:array<{POINT}>,"
    "similarity:double>"
)


@dataclass(frozen=True)
class TrackConfig:
    min_similarity: float = 0.30
    smoothing: float = 0.65
    max_missing: int = 8
    max_faces: int = 1
    cut_threshold: float = 0.45
    detection_interval: int = 1
    full_scan_interval: int = 30
    ambiguity_margin: float = 0.05
    duplicate_iou: float = det.DUPLICATE_IOU
    width: float = 1920.0
    height: float = 1080.0
    use_motion: bool = True
    # "temporal": a full scan when no track has a box; redetects after motion when a track is missing.
    # "frame": a full scan when redetection is needed; redetects also when motion moved nothing.
    profile: str = "temporal"

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_faces", min(IDS_PER_FRAME, max(1, int(self.max_faces))))
        object.__setattr__(self, "duplicate_iou", det.held_iou(self.duplicate_iou))
        if self.profile not in ("temporal", "frame"):
            raise ValueError("profile must be 'temporal' or 'frame'")


class Track:
    """State of one instance: box, points, misses, and what was last recognised there."""

    __slots__ = ("track_id", "box", "kps", "missing", "similarity", "det_id")

    def __init__(self, track_id, box, kps, similarity, det_id, missing=0):
        self.track_id, self.box, self.kps = track_id, box, kps
        self.similarity, self.det_id, self.missing = similarity, det_id, missing

    def instance(self):
        return {
            "track_id": self.track_id, "det_id": self.det_id, "x1": self.box[0], "y1": self.box[1],
            "x2": self.box[2], "y2": self.box[3], "kps": [{"x": x, "y": y} for x, y in self.kps],
            "similarity": self.similarity,
        }


def _points(candidate):
    points = candidate["kps"]
    return [] if points is None else [(p["x"], p["y"]) for p in points]


def _area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _iou(previous, current):
    shared = max(0.0, min(previous[2], current[2]) - max(previous[0], current[0])) * max(
        0.0, min(previous[3], current[3]) - max(previous[1], current[1])
    )
    union = _area(previous) + _area(current) - shared
    return shared / union if union > 0 else 0.0


def _association(previous, current, similarity):
    """Plain-number twin of ``functions.association_score``."""
    iou = _iou(previous, current)
    gap = math.hypot(
        (previous[0] + previous[2] - current[0] - current[2]) / 2, (previous[1] + previous[3] - current[1] - current[3]) / 2
    )
    diagonal = max(
        1.0, math.hypot(previous[2] - previous[0], previous[3] - previous[1]),
        math.hypot(current[2] - current[0], current[3] - current[1]),
    )
    reach = gap / diagonal
    if iou <= 0 and reach > ASSOCIATION_GATE:
        return None
    near = max(0.0, 1.0 - reach / ASSOCIATION_GATE)
    continuity = ASSOCIATION_IOU_WEIGHT * iou + ASSOCIATION_PROXIMITY_WEIGHT * near
    return ASSOCIATION_SIMILARITY_WEIGHT * similarity + ASSOCIATION_CONTINUITY_WEIGHT * continuity


class TrackFold:
    """The tracker as a fold step: feed frames in order, get one output row per frame.

    State is a handful of tracks; it can be saved to and restored from plain lists. A track's id is the frame
    it begins in and its rank among those that begin there, so ids do not depend on where a fold starts.
    """

    def __init__(self, config: TrackConfig, state: dict | None = None, names: list[int] | None = None):
        self.config = config
        self.alpha = min(0.98, max(0.0, config.smoothing))
        self.tracks = [
            Track(t[0], tuple(t[1]), [tuple(p) for p in t[2]], t[3], t[4], t[5]) for t in (state or {"tracks": []})["tracks"]
        ]
        for track, name in zip(self.tracks, names or ()):
            track.track_id = name
        self.frame = self.born = 0

    def snapshot(self, *, anonymous: bool = False) -> dict:
        """Plain state; ``anonymous`` ids count up to -1, which keeps their order, and so every decision."""
        tracks = sorted(self.tracks, key=lambda t: t.track_id) if anonymous else self.tracks
        return {
            "tracks": [
                [i - len(tracks) if anonymous else t.track_id, list(t.box), [list(p) for p in t.kps], t.similarity, t.det_id, t.missing]
                for i, t in enumerate(tracks)
            ],
        }

    def _new_id(self) -> int:
        self.born += 1
        return self.frame * IDS_PER_FRAME + self.born - 1

    @property
    def needs_detection(self) -> bool:
        return not self.tracks or any(t.missing > 0 for t in self.tracks)

    def _miss(self, track):
        track.missing += 1
        return track.missing <= self.config.max_missing

    def assign(self, candidates):
        """Greedy one-to-one assignment; ties go to the higher track id, then the later candidate."""
        taken, updated = set(), []
        pairs = []
        for track in self.tracks:
            for i, c in enumerate(candidates):
                score = _association(track.box, (c["x1"], c["y1"], c["x2"], c["y2"]), c["similarity"])
                if score is not None:
                    pairs.append((score, track.track_id, i))
        by_id = {t.track_id: t for t in self.tracks}
        matched = set()
        for _, track_id, i in sorted(pairs, reverse=True):
            if track_id in matched or i in taken:
                continue
            matched.add(track_id)
            taken.add(i)
            self._smooth(by_id[track_id], candidates[i])
            updated.append(by_id[track_id])
        self.tracks = [t for t in self.tracks if t.track_id in matched or self._miss(t)]
        for i, c in enumerate(candidates):
            if i in taken:
                continue
            if len(self.tracks) >= self.config.max_faces:
                break
            box = (c["x1"], c["y1"], c["x2"], c["y2"])
            track = Track(self._new_id(), box, _points(c), c["similarity"], c["det_id"])
            self.tracks.append(track)
            updated.append(track)
        return sorted(updated, key=lambda t: _area(t.box))

    def _smooth(self, track, c):
        a = self.alpha
        mix = lambda old, new: a * old + (1.0 - a) * new
        track.box = tuple(mix(o, n) for o, n in zip(track.box, (c["x1"], c["y1"], c["x2"], c["y2"])))
        track.kps = [(mix(ox, x), mix(oy, y)) for (ox, oy), (x, y) in zip(track.kps, _points(c))]
        track.similarity, track.det_id, track.missing = c["similarity"], c["det_id"], 0

    def propagate(self, motion):
        """Move every track by the frame's motion; a track that leaves the picture counts as missing."""
        moved, alive = [], []
        for track in self.tracks:
            if motion is not None and self.config.use_motion:
                go = lambda x, y: (
                    motion[0] * x + motion[1] * y + motion[2], motion[3] * x + motion[4] * y + motion[5]
                )
                x1, y1, x2, y2 = track.box
                corners = [go(x, y) for x in (x1, x2) for y in (y1, y2)]
                xs, ys = [c[0] for c in corners], [c[1] for c in corners]
                box = (min(xs), min(ys), max(xs), max(ys))
                if box[2] > 0 and box[3] > 0 and box[0] < self.config.width and box[1] < self.config.height:
                    track.box, track.kps, track.missing = box, [go(x, y) for x, y in track.kps], 0
                    moved.append(track)
                    alive.append(track)
                    continue
            if self._miss(track):
                alive.append(track)
        self.tracks = alive
        return sorted(moved, key=lambda t: _area(t.box))

    def step(self, index, cut, ambiguous, top_similarity, candidates, motion):
        """One frame. ``motion`` is the six affine numbers, or None when absent or not acceptable."""
        cfg = self.config
        self.frame, self.born = index, 0
        if cut:
            self.tracks = []
        needs = self.needs_detection
        due = needs or cut or index % max(1, cfg.detection_interval) == 0
        full_scan = redetected = moved = False
        similarity, flagged = 0.0, False
        if due:
            forced = not self.tracks if cfg.profile == "temporal" else needs
            full_scan = forced or cut or index % max(1, cfg.full_scan_interval) == 0
            flagged = bool(ambiguous) and cfg.profile == "temporal"
            similarity = top_similarity or 0.0
            chosen = self.assign([] if flagged else candidates)
        else:
            chosen = self.propagate(motion)
            moved = bool(chosen)
            if self.needs_detection or (cfg.profile == "frame" and not chosen):
                redetected = True
                chosen = self.assign(candidates)
        instances = [t.instance() for t in chosen]
        if instances:
            similarity = max(t.similarity for t in chosen)
        return (bool(cut), due, full_scan or redetected, redetected, moved, flagged, similarity, instances)


class TargetFold(TrackFold):
    """One target with memory: the best detection by similarity and overlap with the box held, which is smoothed.

    A frame whose best detection is not similar enough, or that has none, is a miss even if a weaker match would pass;
    after more than ``max_missing`` misses the box is dropped. Ties go to the smaller ``det_id``.
    """

    def step(self, index, cut, ambiguous, top_similarity, candidates, motion):
        self.frame, self.born = index, 0
        if cut:
            self.tracks = []
        due = self.needs_detection or bool(cut) or index % max(1, self.config.detection_interval) == 0
        chosen = self._select(candidates) if due else self.propagate(motion)
        instances = [t.instance() for t in chosen]
        similarity = chosen[0].similarity if chosen else (top_similarity or 0.0) if due else 0.0
        return (bool(cut), due, False, False, bool(chosen) and not due, False, similarity, instances)

    def _select(self, candidates):
        held = self.tracks[0] if self.tracks else None
        of = lambda c: (c["x1"], c["y1"], c["x2"], c["y2"])
        score = lambda c: target_score(c["similarity"], _iou(held.box, of(c)) if held else 0.0)
        best = max(candidates, key=lambda c: (score(c), -c["det_id"]), default=None)
        if best is None or best["similarity"] < self.config.min_similarity:
            self.tracks = [t for t in self.tracks if self._miss(t)]
            return []
        if held:
            self._smooth(held, best)
        else:
            self.tracks = [Track(self._new_id(), of(best), _points(best), best["similarity"], best["det_id"])]
        return list(self.tracks)


TRACK_OUTPUT = (
    "scene_cut boolean, detection_due boolean, full_scan boolean, redetected boolean, used_motion boolean, "
    f"ambiguous boolean, similarity double, instances array<{INSTANCE}>"
)


def frame_candidates(detections: DataFrame, config: TrackConfig, *, crowded: int | None = det.CROWDED_FRAME):
    """Per frame, what the tracker needs: suppressed candidates, best first, and the ambiguity verdict.

    Similarity filter, ranking and suppression do not depend on tracker state, so they run as ordinary
    Spark operators and the fold only sees the few survivors. One aggregation serves all of it: two
    similarities can only be ambiguous if both pass the threshold, so the candidate list holds them.
    Frames with more rows than ``crowded`` take a route that never lists them.
    """
    keys = list(det.FRAME)
    if crowded is not None:
        hot = detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).drop("_n")
        if not hot.isEmpty():
            hot = cut_lineage(hot)
            usual = frame_candidates(detections.join(hot, keys, "left_anti"), config, crowded=None)
            return usual.unionByName(_crowded_candidates(detections.join(hot, keys, "left_semi"), config))
    ranked = det.with_rank_key(detections.filter(F.col("similarity").isNotNull()))
    item = F.struct("_key", *CANDIDATE_FIELDS)
    near = F.when(F.col("similarity") >= config.min_similarity, item)
    # Lists do not shrink before a shuffle, so plain rows are shuffled and listed after it.
    listed = ranked.repartition(*keys).groupBy(*keys).agg(
        F.max("similarity").alias("top_similarity"), F.sort_array(F.collect_list(near), asc=False).alias("_all")
    )
    second = F.get("_all", F.lit(1))["similarity"]
    close = F.col("top_similarity") - second < config.ambiguity_margin
    verdict = F.coalesce(close, F.lit(False)) if config.max_faces == 1 else F.lit(False)
    plain = F.transform(
        det.suppress(F.col("_all"), config.duplicate_iou),
        lambda i: F.struct(*(i[c].alias(c) for c in CANDIDATE_FIELDS)),
    )
    return listed.select(*keys, "top_similarity", verdict.alias("ambiguous"), plain.alias("candidates"))


def _crowded_candidates(detections: DataFrame, config: TrackConfig) -> DataFrame:
    keys = list(det.FRAME)
    known = detections.filter(F.col("similarity").isNotNull())
    verdict = det.ambiguity(
        known, margin=config.ambiguity_margin, min_sim=config.min_similarity, max_target_faces=config.max_faces
    )
    near = known.filter(F.col("similarity") >= config.min_similarity).select(*keys, *CANDIDATE_FIELDS, "det_score")
    kept = det.with_rank_key(det.crowded_nms(near, iou=config.duplicate_iou))
    # Survivors overlap less than the threshold, so only so many fit into a frame.
    listed = kept.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_key", *CANDIDATE_FIELDS)), asc=False).alias("_all")
    )
    plain = F.transform("_all", lambda i: F.struct(*(i[c].alias(c) for c in CANDIDATE_FIELDS)))
    return verdict.join(listed, keys, "left").select(
        *keys, "top_similarity", "ambiguous", F.coalesce(plain, F.array().cast(f"array<{CANDIDATE}>")).alias("candidates")
    )


def target_candidates(detections: DataFrame) -> DataFrame:
    """Per frame, the detections that can be the best for some held box.

    An overlap is worth so much similarity at most, so whatever trails the frame's top by more is out before the shuffle.
    """
    keys = list(det.FRAME)
    known = detections.filter(F.col("similarity").isNotNull())
    tops = known.groupBy(*keys).agg(F.max("similarity").alias("top_similarity"))
    near = target_score(F.col("similarity"), F.lit(1.0)) >= target_score(F.col("top_similarity"), F.lit(0.0))
    listed = known.join(tops, keys).filter(near).groupBy(*keys, "top_similarity").agg(F.collect_list(F.struct(*CANDIDATE_FIELDS)).alias("candidates"))
    return listed.select(*keys, "top_similarity", F.lit(False).alias("ambiguous"), "candidates")


def tracking_input(
    frames: DataFrame, found: DataFrame, motion: DataFrame | None, config: TrackConfig
) -> DataFrame:
    """One row per frame: cut, verdict, candidates and accepted motion. Empty frames stay."""
    keys = list(det.FRAME)
    cuts = sequence.scene_cuts(frames, config.cut_threshold).select(*keys, "scene_cut")
    rows = cuts.join(found, keys, "left")
    if motion is None:
        rows = rows.withColumn("motion", F.lit(None).cast("array<double>"))
    else:
        m = Affine.of()
        usable = motion.filter(valid_affine(m, config.width, config.height)).select(
            *keys, F.array(*m).cast("array<double>").alias("motion")
        )
        rows = rows.join(usable, keys, "left")
    empty = F.array().cast(f"array<{CANDIDATE}>")
    return rows.withColumns(
        {
            "candidates": F.coalesce(F.col("candidates").cast(f"array<{CANDIDATE}>"), empty),
            "ambiguous": F.coalesce("ambiguous", F.lit(False)),
        }
    )


def segments(rows: DataFrame, config: TrackConfig) -> DataFrame:
    """(video_id, frame_index, scene_id, segment): segments are the stretches that can be tracked alone.

    A cut drops all tracks. So does a run of ``max_missing + 1`` frames with neither a candidate nor
    acceptable motion, since each of them ages every track by at least one; the frame after it starts empty.
    Works on narrow marks, not on the candidates.
    """
    keys, run = ["video_id"], max(0, config.max_missing) + 1
    dead = ((F.size("candidates") == 0) & F.col("motion").isNull()).cast("double")
    marks = rows.select("video_id", "frame_index", "scene_cut", dead.alias("_dead"))
    recent = ordered.ordered_recent(marks, keys, "frame_index", F.col("_dead"), "_recent", count=run + 1)
    tail = F.slice(F.reverse("_recent"), 1, run)
    idle = (F.size(tail) == run) & ~F.exists(tail, lambda d: d == 0)
    first_idle = idle & F.coalesce(F.get(F.reverse("_recent"), F.lit(run)) == 0, F.lit(True))
    flagged = cut_lineage(
        recent.select(
            *keys, "frame_index", F.col("scene_cut").cast("long").alias("_cut"),
            (F.col("scene_cut") | first_idle).cast("long").alias("_fresh"),
        )
    )
    return ordered.ordered_running_sums(
        flagged, keys, "frame_index", frame_bucket("frame_index"), {"scene_id": F.col("_cut"), "segment": F.col("_fresh")}
    ).drop("_cut", "_fresh")


FOLD_COLUMNS = ("frame_index", "scene_id", "scene_cut", "ambiguous", "top_similarity", "candidates", "motion", "state_in", "names_in")
PIECE = ("video_id", "segment", "chunk")


def _advance(fold: TrackFold, row: tuple) -> tuple:
    index, scene, cut, ambiguous, top, candidates, motion, *_ = row
    top = None if top is None or top != top else top
    moved = None if motion is None else [float(v) for v in motion]
    return (index, scene, *fold.step(index, cut, ambiguous, top, list(candidates), moved))


def _fold_pieces(rows: DataFrame, config: TrackConfig, fold: type[TrackFold] = TrackFold, *, states: bool) -> DataFrame:
    """Fold each piece from its ``state_in``: to its frames, or to the state it ends in and its tracks' ids.

    Without names the tracks a piece begins with have the ids -n to -1.
    """
    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in PIECE)

    def begin(key):
        return [key, None]

    def step(state, row):
        if state[1] is None:
            start, names = row[-2:]
            given = lambda text: json.loads(text) if isinstance(text, str) else None
            state[1] = fold(config, given(start), given(names))
        out = _advance(state[1], row)
        return () if states else [(*state[0], *out)]

    def finish(state):
        if not states:
            return ()
        # No tracks left is the same as not having started.
        left = json.dumps(state[1].snapshot(anonymous=True)) if state[1].tracks else None
        return [(*state[0], left, json.dumps(sorted(t.track_id for t in state[1].tracks)))]

    schema = f"{ddl}, state_out string, ids_out string" if states else f"{ddl}, frame_index long, scene_id long, {TRACK_OUTPUT}"
    return ordered.fold_sorted(rows, list(PIECE), ["frame_index"], list(FOLD_COLUMNS), begin, step, schema, finish=finish)


def _carry(rows: DataFrame, config: TrackConfig) -> DataFrame:
    """What a piece does to the tracks it begins with, where it only moves them: (video_id, segment, chunk, carry).

    In a piece without cut, detection due or lost motion, every box and point goes through the same affine maps. A box's
    centre goes through their product, its half extents through the product of the absolute matrices, so the piece is
    summed up by ten numbers however long it is. ``carry`` is null for all other pieces.
    """
    only_moves = ~F.col("scene_cut") & F.col("motion").isNotNull() & (F.col("frame_index") % F.lit(max(1, config.detection_interval)) != 0) & F.lit(config.use_motion)
    moves = F.sort_array(F.collect_list(F.when(only_moves, F.struct("frame_index", "motion"))))
    per_piece = rows.groupBy(*PIECE).agg(F.min(only_moves).alias("_only"), moves.alias("_moves"))

    def then(before: Column, move: Column) -> Column:
        a, b, tx, c, d, ty = (F.get(move["motion"], F.lit(i)) for i in range(6))
        new = {
            "a": a * before["a"] + b * before["c"], "b": a * before["b"] + b * before["d"], "tx": a * before["tx"] + b * before["ty"] + tx,
            "c": c * before["a"] + d * before["c"], "d": c * before["b"] + d * before["d"], "ty": c * before["tx"] + d * before["ty"] + ty,
            "xx": F.abs(a) * before["xx"] + F.abs(b) * before["yx"], "xy": F.abs(a) * before["xy"] + F.abs(b) * before["yy"],
            "yx": F.abs(c) * before["xx"] + F.abs(d) * before["yx"], "yy": F.abs(c) * before["xy"] + F.abs(d) * before["yy"],
        }
        return F.struct(*(v.alias(n) for n, v in new.items()))

    still = F.struct(*(F.lit(1.0 if n in ("a", "d", "xx", "yy") else 0.0).alias(n) for n in ("a", "b", "tx", "c", "d", "ty", "xx", "xy", "yx", "yy")))
    return per_piece.select(*PIECE, F.when(F.col("_only"), F.to_json(F.aggregate("_moves", still, then))).alias("carry"))


def _moved_state(state: str, carry: str) -> str | None:
    """The state a piece that only moves ends in, or None where it cannot tell."""
    held, m = json.loads(state), json.loads(carry)
    for track in held["tracks"]:
        if track[5]:
            return None  # a track that is missing asks for detection
        x1, y1, x2, y2 = track[1]
        go = lambda x, y: (m["a"] * x + m["b"] * y + m["tx"], m["c"] * x + m["d"] * y + m["ty"])
        (cx, cy), w, h = go((x1 + x2) / 2, (y1 + y2) / 2), (x2 - x1) / 2, (y2 - y1) / 2
        rx, ry = m["xx"] * w + m["xy"] * h, m["yx"] * w + m["yy"] * h
        track[1], track[2] = [cx - rx, cy - ry, cx + rx, cy + ry], [list(go(x, y)) for x, y in track[2]]
    return json.dumps(held)


def _alike(a: str | None, b: str | None) -> bool:
    """Equal but for the last digits of coordinates, which depend on the order maps are multiplied in."""
    if a == b or a is None or b is None:
        return a == b
    a, b = json.loads(a)["tracks"], json.loads(b)["tracks"]
    near = lambda p, q: all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(p, q))
    return len(a) == len(b) and all(
        [p[0], *p[3:]] == [q[0], *q[3:]] and near(p[1], q[1]) and len(p[2]) == len(q[2]) and all(map(near, p[2], q[2])) for p, q in zip(a, b)
    )


def _entry_states(rows: DataFrame, config: TrackConfig, fold: type[TrackFold] = TrackFold) -> DataFrame:
    """What each piece of a long segment starts from: (video_id, segment, chunk, state_in, names_in).

    All pieces are folded at once from an empty state. Then one short row per piece is walked along its segment: a piece
    that was folded from the state it is handed hands on where it ended; one that only moves its tracks hands on the state
    moved by its ``_carry``; any other is taken to forget its start. Pieces that were folded from another state than
    they are handed are folded again, all at once, until none is left. A piece is right once those before it are, so
    this ends with the exact states. Two rounds are the rule, also where tracks ride through many pieces on motion alone.
    States are anonymous; the tracks' ids are handed on from piece to piece at the end.
    """
    keys = list(PIECE)
    none = F.lit(None).cast("string")
    pieces = cut_lineage(_carry(rows, config))
    todo, known = pieces.select(*keys, none.alias("state_in")), None
    while True:
        ran = _fold_pieces(rows.join(todo, keys).withColumn("names_in", none), config, fold, states=True).join(todo, keys)
        known = cut_lineage(ran if known is None else known.join(todo, keys, "left_anti").unionByName(ran))
        walked = cut_lineage(_walk(known.join(pieces, keys)))
        todo = walked.filter(~F.col("right")).select(*keys, "state_in")
        if todo.isEmpty():
            return walked.select(*keys, "state_in").join(_names(known), keys)


def _walk(known: DataFrame) -> DataFrame:
    """The state each piece is handed, and whether it was folded from it."""

    def step(state, row):
        key, handed, moved = state
        chunk, carry, began, ended = (v if isinstance(v, str) or i == 0 else None for i, v in enumerate(row))
        right = _alike(handed, began) if moved else handed == began
        out = [(*key, chunk, handed, right)]
        if not right:
            on = _moved_state(handed, carry) if carry and handed else None
            ended = on if on is not None else ended
        state[1:] = [ended, carry is not None]
        return out

    ddl = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in PIECE)
    rows = known.select(*PIECE, "carry", "state_in", "state_out")
    return ordered.fold_sorted(
        rows, ["video_id", "segment"], ["chunk"], ["chunk", "carry", "state_in", "state_out"], lambda key: [key, None, False], step,
        f"{ddl}, state_in string, right boolean",
    )


def _names(ended: DataFrame) -> DataFrame:
    """Ids of the tracks each piece begins with; one short row per piece is folded along its segment."""

    def step(state, row):
        chunk, ids = row
        out = [(*state[0], chunk, json.dumps(state[1]) if state[1] else None)]
        state[1] = [state[1][i] if i < 0 else i for i in json.loads(ids)]
        return out

    ddl = ", ".join(f"{c} {ended.schema[c].dataType.simpleString()}" for c in PIECE)
    return ordered.fold_sorted(
        ended.select(*PIECE, "ids_out"), ["video_id", "segment"], ["chunk"], ["chunk", "ids_out"], lambda key: [key, []], step, f"{ddl}, names_in string"
    )


def track(
    frames: DataFrame, detections: DataFrame, motion: DataFrame | None = None, config: TrackConfig = TrackConfig(),
    *, crowded: int | None = det.CROWDED_FRAME, split: bool = True, chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Track instances through every video; one row per frame with its instances.

    Videos are folded per segment (see ``segments``), and segments longer than ``chunk_frames`` in pieces of
    that length (see ``_entry_states``), so long videos spread over the cluster; a fold holds one Arrow batch
    and a few tracks. Track ids are unique in a video and do not depend on how it is split.
    """
    found = frame_candidates(detections, config, crowded=crowded)
    return _folded(tracking_input(frames, found, motion, config), config, TrackFold, split, chunk_frames)


def _folded(rows: DataFrame, config: TrackConfig, fold: type[TrackFold], split: bool, chunk_frames: int) -> DataFrame:
    rows = cut_lineage(rows)
    places = segments(rows, config)
    if not split:
        places = places.withColumn("segment", F.lit(0).cast("long"))
    none = F.lit(None).cast("string")
    whole = rows.join(places, list(det.FRAME)).withColumns({"chunk": F.lit(0).cast("long"), "names_in": none})
    if not split:
        return _fold_pieces(whole.withColumn("state_in", none), config, fold, states=False)
    long = places.groupBy("video_id", "segment").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > chunk_frames
    ).drop("_n")
    if long.isEmpty():
        return _fold_pieces(whole.withColumn("state_in", none), config, fold, states=False)
    long = cut_lineage(long)
    cut = cut_lineage(
        whole.join(long, ["video_id", "segment"], "left_semi").withColumn("chunk", frame_bucket("frame_index", chunk_frames))
    )
    usual = whole.join(long, ["video_id", "segment"], "left_anti").withColumn("state_in", none)
    pieces = cut.drop("names_in").join(_entry_states(cut.drop("names_in"), config, fold), list(PIECE))
    return _fold_pieces(usual, config, fold, states=False).unionByName(_fold_pieces(pieces, config, fold, states=False))


def follow_target(
    frames: DataFrame, detections: DataFrame, motion: DataFrame | None = None, config: TrackConfig = TrackConfig(),
    *, split: bool = True, chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Follow one target per video with memory (see ``TargetFold``); one row per frame, without box where it is missed.

    Split as ``track`` is. Where detection is not due the box moves with the frame's motion.
    """
    followed = _folded(tracking_input(frames, target_candidates(detections), motion, config), config, TargetFold, split, chunk_frames)
    one = F.get("instances", F.lit(0))
    return followed.select(
        "video_id", "frame_index", "scene_cut", "detection_due", "used_motion", (F.size("instances") > 0).alias("located"),
        *(one[c].alias(c) for c in ("track_id", "det_id", "x1", "y1", "x2", "y2", "kps")), "similarity",
    )


def instance_fields(instances: Column) -> Column:
    """Add area, yaw and pitch to each instance."""

    def enrich(item: Column) -> Column:
        yaw, pitch = pose_from_kps(item["kps"])
        return (
            item.withField("area", bbox_area(Box.in_struct(item))).withField("yaw", yaw).withField("pitch", pitch)
        )

    return F.transform(instances, enrich)


def to_track_frames(tracked: DataFrame) -> DataFrame:
    """Per frame: primary box (largest area, first on ties), best similarity, pose and instance count."""
    rich = tracked.withColumn("_items", instance_fields(F.col("instances")))
    ordered_items = F.transform(
        "_items", lambda item, i: F.struct((-item["area"]).alias("big"), i.alias("at"), item.alias("item"))
    )
    primary = F.array_min(ordered_items)["item"]
    located = F.size("instances") > 0
    picked = rich.withColumn("_primary", F.when(located, primary))
    return picked.select(
        "video_id", "frame_index", "scene_cut", "ambiguous", located.alias("located"),
        F.size("instances").alias("n_instances"), "similarity",
        *(F.col(f"_primary.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")),
        *(F.coalesce(F.col(f"_primary.{c}"), F.lit(0.0)).alias(c) for c in ("yaw", "pitch")),
        "instances",
    )


def instances_to_frames(instances: DataFrame, frames: DataFrame) -> DataFrame:
    """TRK5 from instance rows: one row per frame of ``frames`` (with scene_cut, ambiguous).

    Aggregates only, so a crowded frame is combined before the shuffle.
    """
    keys = list(det.FRAME)
    area = bbox_area(Box.of())
    main = F.struct("det_id", "x1", "y1", "x2", "y2", "yaw", "pitch")
    grouped = instances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_instances"), F.max("similarity").alias("similarity"),
        F.max_by(main, F.struct(area, -F.col("det_id"))).alias("_main"),
    )
    joined = frames.join(grouped, keys, "left")
    located = F.col("_main").isNotNull() & ~F.col("ambiguous")
    shown = lambda c: F.when(located, F.col(f"_main.{c}"))
    return joined.select(
        *keys, "scene_cut", "ambiguous", located.alias("located"),
        F.when(located, F.col("n_instances")).otherwise(F.lit(0)).cast("long").alias("n_instances"),
        F.coalesce(F.when(located, F.col("similarity")), F.lit(0.0)).alias("similarity"),
        shown("det_id").alias("det_id"), *(shown(c).alias(c) for c in ("x1", "y1", "x2", "y2")),
        *(F.coalesce(shown(c), F.lit(0.0)).alias(c) for c in ("yaw", "pitch")),
    )


def associate(tracks: DataFrame, candidates: DataFrame, *, max_faces: int = 2, smoothing: float = 0.65):
    """Greedy one-to-one assignment for single frames.

    ``tracks`` has per frame an array ``tracks`` of {track_id, x1, y1, x2, y2}; ``candidates`` has the array
    that ``frame_candidates`` makes. One row per chosen pair or newly opened track.
    """
    config = TrackConfig(max_faces=max_faces, smoothing=smoothing)
    keys = list(det.FRAME)
    rows = candidates.select(*keys, "candidates").join(tracks, keys, "left")
    key_type = rows.schema["video_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for video, frame, found, running in zip(*(batch[c].tolist() for c in (*keys, "candidates", "tracks"))):
                running = [] if running is None else list(running)
                fold = TrackFold(config, {
                    "tracks": [
                        [t["track_id"], (t["x1"], t["y1"], t["x2"], t["y2"]), [], 0.0, -1, 0] for t in running
                    ],
                })
                fold.born = max((t["track_id"] for t in running), default=-1) + 1  # new ids go on from the largest
                before = {t["track_id"] for t in running}
                for t in fold.assign([] if found is None else list(found)):
                    out.append((video, frame, t.track_id, t.det_id, t.track_id not in before, *t.box))
            yield pd.DataFrame(
                out, columns=[*keys, "track_id", "det_id", "opened", "x1", "y1", "x2", "y2"]
            )

    return rows.mapInPandas(
        run,
        f"video_id {key_type}, frame_index long, track_id long, det_id long, opened boolean, x1 double, y1 double, "
        "x2 double, y2 double",
    )


def select_target(detections: DataFrame, *, min_similarity: float) -> DataFrame:
    """Best detection per frame by selection score, each frame by itself; below the threshold none. ``follow_target`` has memory."""
    from framelens.functions import selection_score

    score = selection_score(F.col("similarity"), Box.of())
    best = detections.filter(F.col("similarity").isNotNull()).groupBy(*det.FRAME).agg(
        F.max_by(
            F.struct("det_id", "similarity", "x1", "y1", "x2", "y2"), F.struct(score, -F.col("det_id"))
        ).alias("_best")
    )
    return best.select(*det.FRAME, "_best.*").filter(F.col("similarity") >= min_similarity)


def motion_step(state: DataFrame, motion: DataFrame, config: TrackConfig) -> DataFrame:
    """As-of step: move each frame's latest earlier box by this frame's motion.

    ``state`` holds observed boxes per frame. The result has one row per motion row that has an earlier box,
    with the moved box and whether it is accepted.
    """
    from framelens.functions import affine_bbox, bbox_visible

    boxes = state.select(*det.FRAME, F.struct("x1", "y1", "x2", "y2").alias("box"))
    merged = motion.join(boxes, list(det.FRAME), "left")
    latest = ordered.ordered_last_value(
        merged, ["video_id"], "frame_index", frame_bucket("frame_index"), F.col("box"), "last_box", inclusive=False
    ).filter(F.col("last_box").isNotNull())
    m = Affine.of()
    moved = affine_bbox(Box.in_struct(F.col("last_box")), m)
    accepted = valid_affine(m, config.width, config.height) & bbox_visible(moved, config.width, config.height)
    return latest.select(
        *det.FRAME, *(v.alias(f"moved_{n}") for n, v in zip(("x1", "y1", "x2", "y2"), moved)),
        accepted.alias("accepted"),
    )


def similarity_to_target(detections: DataFrame, targets: DataFrame, *, key: str = "video_id") -> DataFrame:
    """Join each video's target embedding (``target``) and add ``similarity``.

    Up to a checked number of targets the detections are not shuffled for it.
    """
    from framelens.functions import cosine

    return detections.join(bounded(targets.select(key, as_doubles("target").alias("target"))), key).withColumn(
        "similarity", cosine("embedding", "target")
    ).drop("target")


def track_quality_gate(
    frames: DataFrame, detections: DataFrame, motion: DataFrame | None = None, config: TrackConfig = TrackConfig(),
    *, min_coverage: float = 0.05, max_ambiguous: float = 0.15, strict: bool = False,
    crowded: int | None = det.CROWDED_FRAME,
) -> DataFrame:
    tracked = to_track_frames(track(frames, detections, motion, config, crowded=crowded))
    return filters.track_gate(
        sequence.track_summary(tracked), min_coverage=min_coverage, max_ambiguous=max_ambiguous, strict=strict
    )
