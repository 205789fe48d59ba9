"""Check SQL of the tracker: a recursive query over the frames of a video, whose state is the list of running tracks.

At most two tracks run at once, so the greedy assignment of a frame is its best pair and then the best of the pairs
that share neither track nor candidate with it.
"""

from __future__ import annotations

from framelens.plans.identity_queries import nms_sql
from framelens.plans.scalar_queries import DISTANCE, HIST_PAIRS, VALID_MOTION, area_sql, diagonal_sql, gap_sql, iou_sql, moved_box_sql

_TRACK = "STRUCT(id BIGINT, det BIGINT, sim DOUBLE, miss BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)"
_BOX = "'x1': {0}.x1, 'y1': {0}.y1, 'x2': {0}.x2, 'y2': {0}.y2"
_SCORE = (
    f"CASE WHEN {iou_sql('t', 'c')} <= 0 AND {gap_sql('t', 'c')} / greatest({diagonal_sql('t')}, {diagonal_sql('c')}) > 2.4 THEN NULL "
    f"ELSE 0.55 * c.sim + 0.45 * (0.72 * {iou_sql('t', 'c')} + 0.28 * greatest(0.0, 1 - {gap_sql('t', 'c')} / greatest({diagonal_sql('t')}, {diagonal_sql('c')}) / 2.4)) END"
)


def _moved(t: str = "t", head: str = "'id': t.id, ") -> str:
    """A track after the frame's motion; one that cannot move, or leaves, has missed."""
    x1, y1, x2, y2 = moved_box_sql(t, "mo")
    return (
        f"CASE WHEN mo IS NOT NULL AND {x2} > 0 AND {y2} > 0 AND {x1} < 240 AND {y1} < 180 "
        f"THEN {{{head}'det': {t}.det, 'sim': {t}.sim, 'miss': CAST(0 AS BIGINT), 'x1': {x1}, 'y1': {y1}, 'x2': {x2}, 'y2': {y2}}} "
        f"ELSE {{{head}'det': {t}.det, 'sim': {t}.sim, 'miss': {t}.miss + 1, {_BOX.format(t)}}} END"
    )


_MOTION = "CASE WHEN {0} THEN {{'m00': m00, 'm01': m01, 'm02': m02, 'm10': m10, 'm11': m11, 'm12': m12}} END AS mo".format(VALID_MOTION)


def track_steps(cut: float, *, max_faces: int = 2, profile: str = "temporal", lost: str = "false") -> str:
    """CTEs ending in ``step``: one row per frame with flags, similarity and ``chosen``, smallest box first.

    Of frames that are ``lost`` nothing is known: no histogram, candidate or motion.
    """
    ambiguous = "coalesce(a.ambiguous, false)" if max_faces == 1 else "false"
    forced = "len(t0) = 0" if profile == "temporal" else "needs"
    flagged = "due AND amb" if profile == "temporal" else "false"
    again = "len(alive) = 0 OR len(list_filter(alive, lambda t: t.miss > 0)) > 0" + (" OR NOT any_moved" if profile == "frame" else "")
    smooth = ", ".join(f"'{c}': 0.5 * list_filter(cur, lambda t: t.id = p.id)[1].{c} + 0.5 * list_filter(aset, lambda c: c.i = p.i)[1].{c}" for c in ("x1", "y1", "x2", "y2"))
    return f"""RECURSIVE survivors AS MATERIALIZED ({nms_sql("SELECT * FROM v_sim WHERE similarity >= 0.05")}),
cands AS (SELECT v.*, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY similarity DESC, coalesce(det_score, 0) DESC, w * h DESC, det_id) AS i FROM v_sim v JOIN survivors USING (video_id, frame_index, det_id)),
listed AS (SELECT video_id, frame_index, list({{'i': i, 'det': det_id, 'sim': similarity, {_BOX.format('cands')}}} ORDER BY i) AS cands FROM cands GROUP BY video_id, frame_index),
tops AS (SELECT video_id, frame_index, max(similarity) AS top FROM v_sim WHERE similarity IS NOT NULL GROUP BY video_id, frame_index),
cuts AS (SELECT video_id, frame_index, coalesce({DISTANCE} >= {cut}, false) AS cut, false AS gone FROM ({HIST_PAIRS.replace("v_hist", f"(SELECT * FROM v_hist WHERE NOT ({lost})) x")}) h
  UNION ALL SELECT video_id, frame_index, false, true FROM v_hist WHERE {lost}),
inp AS MATERIALIZED (
  SELECT c.video_id, c.frame_index, c.cut, c.gone, row_number() OVER (PARTITION BY c.video_id ORDER BY c.frame_index) AS k, NOT c.gone AND {ambiguous} AS amb,
         CASE WHEN NOT c.gone THEN tops.top END AS top, CASE WHEN c.gone THEN [] ELSE coalesce(l.cands, []) END AS cands, {_MOTION.replace("CASE WHEN ", "CASE WHEN NOT c.gone AND ", 1)}
  FROM cuts c LEFT JOIN tops USING (video_id, frame_index) LEFT JOIN listed l USING (video_id, frame_index)
  LEFT JOIN v_motion m USING (video_id, frame_index) LEFT JOIN v_ambiguous a USING (video_id, frame_index)),
step AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_index, CAST([] AS {_TRACK}[]) AS tracks, CAST([] AS {_TRACK}[]) AS chosen,
         false AS cut, false AS due, false AS full_scan, false AS redetected, false AS ambiguous, CAST(0 AS DOUBLE) AS similarity FROM inp
  UNION ALL
  SELECT video_id, k, frame_index, CASE WHEN aset IS NULL THEN alive ELSE list_concat(stay, born) END, chosen, cut, due,
         coalesce(full_scan, false) OR redo, redo, flag, CASE WHEN len(chosen) > 0 THEN list_max(list_transform(chosen, lambda t: t.sim)) WHEN due THEN coalesce(top, 0) ELSE 0 END
  FROM (SELECT *, list_transform(list_sort(list_transform(
            CASE WHEN aset IS NULL THEN list_filter(alive, lambda t: t.miss = 0) ELSE list_concat(hit, born) END,
            lambda t, j: {{'a': {area_sql('t')}, 'j': j, 't': t}})), lambda s: s.t) AS chosen
  FROM (SELECT *, CAST(list_transform(list_slice(list_filter(aset, lambda c: NOT list_contains(list_transform(pick, lambda p: p.i), c.i)), 1, greatest(0, {max_faces} - len(stay))),
            lambda c, j: {{'id': frame_index * 65536 + j - 1, 'det': c.det, 'sim': c.sim, 'miss': CAST(0 AS BIGINT), {_BOX.format('c')}}}) AS {_TRACK}[]) AS born
  FROM (SELECT *, list_filter(list_transform(cur, lambda t: CASE WHEN list_contains(list_transform(hit, lambda h: h.id), t.id) THEN list_filter(hit, lambda h: h.id = t.id)[1]
            ELSE {{'id': t.id, 'det': t.det, 'sim': t.sim, 'miss': t.miss + 1, {_BOX.format('t')}}} END), lambda t: t.miss <= 2) AS stay
  FROM (SELECT *, CAST(list_transform(pick, lambda p: {{'id': p.id, 'det': list_filter(aset, lambda c: c.i = p.i)[1].det, 'sim': list_filter(aset, lambda c: c.i = p.i)[1].sim,
            'miss': CAST(0 AS BIGINT), {smooth}}}) AS {_TRACK}[]) AS hit
  FROM (SELECT *, list_filter([pairs[1], list_filter(pairs, lambda p: p.id <> pairs[1].id AND p.i <> pairs[1].i)[1]], lambda p: p IS NOT NULL) AS pick
  FROM (SELECT *, list_reverse_sort(list_filter(flatten(list_transform(cur, lambda t: list_transform(aset, lambda c: {{'score': {_SCORE}, 'id': t.id, 'i': c.i}}))), lambda p: p.score IS NOT NULL)) AS pairs
  FROM (SELECT *, CASE WHEN flag THEN [] WHEN due OR redo THEN cands END AS aset, CASE WHEN due THEN t0 ELSE alive END AS cur
  FROM (SELECT *, NOT due AND ({again}) AS redo
  FROM (SELECT *, NOT due AND len(list_filter(alive, lambda t: t.miss = 0)) > 0 AS any_moved
  FROM (SELECT *, {flagged} AS flag, due AND ({forced} OR cut OR frame_index % 9 = 0) AS full_scan,
            list_filter(list_transform(t0, lambda t: {_moved()}), lambda t: t.miss <= 2) AS alive
  FROM (SELECT *, needs OR cut OR frame_index % 3 = 0 AS due
  FROM (SELECT *, len(t0) = 0 OR len(list_filter(t0, lambda t: t.miss > 0)) > 0 AS needs
  FROM (SELECT n.*, CASE WHEN n.cut THEN CAST([] AS {_TRACK}[]) ELSE s.tracks END AS t0 FROM step s JOIN inp n ON n.video_id = s.video_id AND n.k = s.k + 1
  ) q1) q2) q3) q4) q5) q6) q7) q8) q9) q10) q11) q12) q13)"""


def target_steps(cut: float, *, min_similarity: float = 0.15) -> str:
    """CTEs ending in ``step``: one row per frame; ``held`` is the one box remembered, ``chosen`` the frame's, if any."""
    held = "STRUCT(det BIGINT, sim DOUBLE, miss BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)"
    score = f"0.78 * c.sim + 0.22 * coalesce({iou_sql('h', 'c')}, 0)"
    smooth = ", ".join(f"'{c}': 0.5 * h.{c} + 0.5 * best.{c}" for c in ("x1", "y1", "x2", "y2"))
    return f"""RECURSIVE listed AS (SELECT video_id, frame_index, list({{'det': det_id, 'sim': similarity, {_BOX.format('v')}}}) AS cands, max(similarity) AS top FROM v_sim v WHERE similarity IS NOT NULL GROUP BY video_id, frame_index),
cuts AS (SELECT video_id, frame_index, coalesce({DISTANCE} >= {cut}, false) AS cut FROM ({HIST_PAIRS}) h),
inp AS MATERIALIZED (
  SELECT c.video_id, c.frame_index, c.cut, row_number() OVER (PARTITION BY c.video_id ORDER BY c.frame_index) AS k, l.top, coalesce(l.cands, []) AS cands, {_MOTION}
  FROM cuts c LEFT JOIN listed l USING (video_id, frame_index) LEFT JOIN v_motion m USING (video_id, frame_index)),
step AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_index, CAST(NULL AS {held}) AS held, CAST(NULL AS {held}) AS chosen, false AS cut, false AS due, CAST(0 AS DOUBLE) AS similarity FROM inp
  UNION ALL
  SELECT video_id, k, frame_index, CASE WHEN hit IS NOT NULL THEN hit WHEN h.miss < 2 THEN CAST({{'det': h.det, 'sim': h.sim, 'miss': h.miss + 1, {_BOX.format('h')}}} AS {held}) END, hit, cut, due,
         CASE WHEN hit IS NOT NULL THEN hit.sim WHEN due THEN coalesce(top, 0) ELSE 0 END
  FROM (SELECT *, CASE WHEN due AND best.sim >= {min_similarity} THEN CAST(CASE WHEN h IS NULL THEN {{'det': best.det, 'sim': best.sim, 'miss': 0, {_BOX.format('best')}}} ELSE {{'det': best.det, 'sim': best.sim, 'miss': 0, {smooth}}} END AS {held})
                       WHEN NOT due AND moved.miss = 0 THEN moved END AS hit
  FROM (SELECT *, list_reverse_sort(list_transform(cands, lambda c: {{'s': {score}, 'd': -c.det, 'c': c}}))[1].c AS best, CAST({_moved('h', '')} AS {held}) AS moved
  FROM (SELECT *, h IS NULL OR h.miss > 0 OR cut OR frame_index % 3 = 0 AS due
  FROM (SELECT n.*, CASE WHEN n.cut THEN NULL ELSE s.held END AS h FROM step s JOIN inp n ON n.video_id = s.video_id AND n.k = s.k + 1
  ) q1) q2) q3) q4)"""
