import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import grid, identity, runs

REF = "ref_id long, identity_id long, path string, embedding array<double>, yaw double, pitch double, quality double, weight double"


def references(spark, rows):
    return spark.createDataFrame([(i, 1, f"bank/{i}.png", e, y, p, q, w) for i, (e, y, p, q, w) in enumerate(rows)], REF)


def test_bank_keeps_left_front_and_right(spark):
    rows = [([1.0, 0.0], yaw, 0.0, q, q) for yaw, q in ((-35.0, 0.75), (0.0, 0.80), (34.0, 0.78), (5.0, 0.95))]
    bank = identity.diverse_references(references(spark, rows), 3).collect()
    assert [r.ref_id for r in sorted(bank, key=lambda r: r.bank_order)] == [0, 3, 2]
    assert identity.diverse_references(references(spark, rows), 0).count() == 0
    assert identity.diverse_references(references(spark, rows), 9).count() == 4
    left = identity.remaining_references(references(spark, rows), identity.diverse_references(references(spark, rows), 3))
    assert [r.ref_id for r in left.collect()] == [1]


def test_centroid(spark):
    rows = [([2.0, 0.0], 0.0, 0.0, 1.0, 3.0), ([0.0, 5.0], 0.0, 0.0, 1.0, 1.0), ([0.0, 0.0], 0.0, 0.0, 1.0, 9.0)]
    made = identity.identity_centroid(references(spark, rows)).collect()[0]
    assert made.centroid == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert made.n_refs == 3


@pytest.mark.parametrize("bank_rows", [4096, 16])
def test_matching_small_and_blocked_banks(spark, bank_rows):
    rng = np.random.default_rng(1)
    refs, dets = rng.normal(size=(70, 8)), rng.normal(size=(40, 8))
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(refs)], "ref_id long, embedding array<double>")
    found = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dets)] + [(99, None)], "det_id long, embedding array<double>")
    got = {}
    for r in identity.match_identity(found, bank, min_sim=0.2, k=3, bank_rows=bank_rows).collect():
        got.setdefault(r.det_id, []).append((r.rank, r.ref_id, round(r.similarity, 9)))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(dets) @ unit(refs).T
    for d in range(40):
        best = sorted(((-sims[d, r], r) for r in range(70) if sims[d, r] >= 0.2))[:3]
        assert sorted(got.get(d, [])) == [(i + 1, r, round(-s, 9)) for i, (s, r) in enumerate(best)]
    assert 99 not in got


def test_reference_pick_follows_pose(spark):
    rows = [([1.0, 0.0], yaw, 0.0, 0.5, 0.5) for yaw in (-40.0, 0.0, 40.0)]
    bank = identity.diverse_references(references(spark, rows), 3)
    clips = spark.createDataFrame([(1, 0, 1, 33.0, 0.0), (1, 1, 1, None, None)], "video_id long, clip_index long, identity_id long, yaw double, pitch double")
    assert {r.clip_index: r.picked_ref for r in identity.pick_reference(clips, bank).collect()} == {0: 2, 1: 0}


def flood(cells):
    """Components by plain flood fill: cell to smallest cell number."""
    left, out = set(cells), {}
    while left:
        stack, part = [left.pop()], []
        while stack:
            x, y = stack.pop()
            part.append((x, y))
            for near in [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
                if near in left:
                    left.remove(near)
                    stack.append(near)
        name = min(y * 2**31 + x for x, y in part)
        out.update({cell: (name, len(part)) for cell in part})
    return out


@pytest.mark.parametrize("route", ["frames", "spread"])
def test_components_against_flood_fill(spark, monkeypatch, route):
    if route == "spread":
        monkeypatch.setattr(grid, "TASK_CELLS", 50)
    rng = random.Random(9)
    sets = {f: {(rng.randrange(20), rng.randrange(14)) for _ in range(n)} for f, n in ((1, 130), (2, 60), (3, 1))}
    rows = [(f, x, y, 255) for f, cells in sets.items() for x, y in cells] + [(4, 0, 0, 3)]
    df = spark.createDataFrame(rows, "frame_id long, cx long, cy long, v int").repartition(5)
    got = {(r.frame_id, r.cx, r.cy): (r.component, r.area) for r in grid.component_label(df, 1).collect()}
    want = {(f, x, y): v for f, cells in sets.items() for (x, y), v in flood(cells).items()}
    assert got == want


def ellipse_cells(frame, cx, cy, rx, ry, v=255):
    return [
        (frame, x, y, v) for x in range(int(cx - rx), int(cx + rx) + 1) for y in range(int(cy - ry), int(cy + ry) + 1)
        if ((x - cx) / rx) ** 2 + ((y - cy) / ry) ** 2 <= 1
    ]


def instance(frame, number, box):
    x1, y1, x2, y2 = (float(b) for b in box)
    w, h = x2 - x1, y2 - y1
    kps = [(x1 + fx * w, y1 + fy * h) for fx, fy in ((0.32, 0.38), (0.68, 0.38), (0.5, 0.54), (0.38, 0.72), (0.62, 0.72))]
    return (frame, number, x1, y1, x2, y2, kps)


def refine(spark, cells, instances, width, height):
    schema = "frame_id long, instance long, x1 double, y1 double, x2 double, y2 double, kps array<struct<x:double,y:double>>"
    refined, counters = grid.refine_regions(
        spark.createDataFrame(cells, "frame_id long, cx long, cy long, v int"), spark.createDataFrame(instances, schema), width=width, height=height
    )
    return {(r.cx, r.cy): r.v for r in refined.collect()}, counters.collect()


def test_mask_keeps_the_match_and_adds_the_reflection(spark):
    mask, counters = refine(
        spark, ellipse_cells(1, 38, 52, 20, 29), [instance(1, 0, (16, 18, 60, 86)), instance(1, 1, (104, 24, 142, 84))], 160, 100
    )
    assert mask[(38, 52)] == 255 and mask[(123, 54)] == 255 and (80, 8) not in mask
    assert (counters[0].kept_raw_components, counters[0].synthetic_instances_added) == (1, 1)


def test_mask_drops_an_unrelated_component(spark):
    mask, counters = refine(spark, ellipse_cells(1, 90, 62, 34, 42), [instance(1, 0, (15, 25, 55, 90))], 180, 120)
    assert mask[(35, 58)] == 255 and (90, 62) not in mask
    assert (counters[0].raw_components, counters[0].kept_raw_components, counters[0].synthetic_instances_added) == (1, 0, 1)


def test_mask_without_instances_is_empty(spark):
    mask, counters = refine(spark, ellipse_cells(1, 90, 62, 34, 42), [instance(2, 0, (15, 25, 55, 90))], 180, 120)
    assert not any((x, y) == (90, 62) for x, y in mask) and all(c.frame_id == 2 for c in counters)


def test_pixel_stats_mirror_the_border(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, size=(5, 7)).astype(float)
    rows = [(1, x, y, int(image[y, x])) for y in range(5) for x in range(7)]
    got = grid.pixel_stats(spark.createDataFrame(rows, "frame_id long, cx long, cy long, v int")).collect()[0]
    p = np.pad(image, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image
    assert got.mean == pytest.approx(image.mean()) and got.sharpness_var == pytest.approx(lap.var())
    assert got.clipped_fraction == pytest.approx(np.mean((image <= 5) | (image >= 250)))


def test_small_groups_are_not_matched(spark):
    df = spark.createDataFrame([("N", float(i)) for i in range(200)] + [("A", 5.0)], "g string, x double")
    rows = grid.moment_match(df, "x", "g", "N").filter(F.col("g") == "A").collect()
    assert rows[0].matched == 5.0


def test_large_banks_match_as_small_ones_with_repeating_ids(spark):
    refs = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "ref_id long, embedding array<double>")
    found = spark.createDataFrame([(1, f, 0, [float(f == j) for j in range(8)]) for f in range(8)] + [(None, 3, 0, [1.0] + [0.0] * 7)], "video_id long, frame_index long, det_id long, embedding array<double>")
    match = lambda rows, size: sorted(map(str, identity.match_identity(found, refs, min_sim=0.5, k=2, bank_rows=rows, bank_bytes=size).collect()))
    assert match(4, 0) == match(4, 1 << 20) == match(100, 0) and len(match(4, 0)) == 9


def test_pixel_neighbours_are_adjacent_cells(spark):
    cells = lambda xs: spark.createDataFrame([(1, x, 0, v) for x, v in xs], "frame_id long, cx long, cy long, v double")
    got = grid.pixel_stats(cells([(0, 10.0), (5, 90.0), (6, 20.0)])).first()
    # 0 stands alone; 5 and 6 mirror each other: 2 * (20 - 90) and 2 * (90 - 20)
    assert got.sharpness_var == pytest.approx(2 * 140.0**2 / 3)


def test_approximate_matching_keeps_its_recall(spark):
    rng = np.random.default_rng(6)
    bank = rng.normal(size=(3000, 32))
    unit = bank / np.linalg.norm(bank, axis=1, keepdims=True)
    away = rng.normal(size=unit.shape)
    away -= (away * unit).sum(1, keepdims=True) * unit
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    probes = 0.86 * unit + np.sqrt(1 - 0.86**2) * away  # just above the threshold
    bank[2000:2600] = bank[7]  # a hot vector
    references = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(bank)] + [(5000, None), (5001, [1.0])], "ref_id long, embedding array<double>")
    detections = spark.createDataFrame([(i, (v * 3).tolist()) for i, v in enumerate(probes)] + [(6000, None), (6001, [0.0] * 32), (6002, [1.0])], "det_id long, embedding array<double>")
    assert identity.SignCodes.plan(0.85, 0.9, 3000)[0] > 1 and identity.SignCodes.plan(0.1, 0.9, 3000) is None
    exact = {(r.det_id, r.ref_id): (r.rank, r.similarity) for r in identity.match_identity(detections, references, min_sim=0.85, k=2).collect()}
    near = {(r.det_id, r.ref_id): (r.rank, r.similarity) for r in identity.match_identity(detections, references, min_sim=0.85, k=2, recall=0.9).collect()}
    assert len(exact) > 2300 and len(near.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(exact[pair][1] - near[pair][1]) < 1e-9 for pair in near.keys() & exact.keys())
    assert sorted(ref for det, ref in near if det == 7) == [7, 2000]


@pytest.mark.parametrize("strip", [1, 3, 256])
def test_component_runs_join_across_strips(spark, strip):
    rng = random.Random(9)
    sets = {f: {(rng.randrange(24), rng.randrange(17)) for _ in range(n)} for f, n in (("a", 170), ("b", 90), ("c", 1))}
    sets["d"] = {(x, y) for y in range(0, 16) for x in range(20) if y % 4 == 0 or x == (19 if y % 8 < 4 else 0)}  # one winding line
    df = spark.createDataFrame([(f, x, y, 255) for f, cells in sets.items() for x, y in cells] + [("e", 0, 0, 3), (None, 1, 1, 255)], "frame_id string, cx long, cy int, v int").repartition(5)
    got = runs.open_runs(runs.component_runs(df, 2, strip=strip)).collect()
    want = {(f, x, y): v for f, cells in sets.items() for (x, y), v in flood(cells).items() if v[1] >= 2}
    assert {(r.frame_id, r.cx, r.cy): (r.component, r.area) for r in got} == want and len(got) == len(want)


def test_spans_are_the_cells_of_the_ellipse(spark):
    from framelens.functions import Box, ellipse_contains

    rng = random.Random(4)
    boxes = [instance(1, i, (x, y, x + rng.uniform(1, 40), y + rng.uniform(1, 50))) for i in range(60) for x, y in [(rng.uniform(-10, 60), rng.uniform(-10, 50))]]
    boxes = [(*b[:6], None if i % 5 == 0 else [(p[0], p[1] + (k == 1) * rng.uniform(-9, 9)) for k, p in enumerate(b[6])]) for i, b in enumerate(boxes)]
    boxes += [(1, 90, 10.0, 10.0, 20.0, 20.0, None)]  # borders on whole numbers
    df = spark.createDataFrame(boxes, "frame_id long, instance long, x1 double, y1 double, x2 double, y2 double, kps array<struct<x:double,y:double>>")
    eye = lambda i, c: F.coalesce(F.get("kps", F.lit(i))[c], F.lit(0.0))
    opened = df.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(47))))
    inside = ellipse_contains(F.col("cx").cast("double"), F.col("cy").cast("double"), Box.of(), variant="oriented", left_eye=(eye(0, "x"), eye(0, "y")), right_eye=(eye(1, "x"), eye(1, "y")))
    want = {(r.instance, r.cx, r.cy) for r in opened.filter(inside).collect()}
    assert {(r.instance, r.cx, r.cy) for r in grid.instance_cells(df, 64, 48).collect()} == want and len(want) > 1000


def test_union_of_runs(spark):
    rng = random.Random(2)
    rows = [(1, rng.randrange(3), a, a + rng.randrange(6)) for a in (rng.randrange(60) for _ in range(40))]
    merged = runs.union(spark.createDataFrame(rows, "frame_id long, cy long, x0 long, x1 long")).collect()
    cells = {(y, x) for _, y, a, b in rows for x in range(a, b + 1)}
    assert {(r.cy, x) for r in merged for x in range(r.x0, r.x1 + 1)} == cells and sum(r.x1 - r.x0 + 1 for r in merged) == len(cells)
    assert all((r.cy, r.x0 - 1) not in cells and (r.cy, r.x1 + 1) not in cells for r in merged)


def test_blocks_and_codes_meet_as_matrices(spark, monkeypatch):
    """Blocks, heavy codes in parts, equal vectors, and vectors that match nothing, against plain sums."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 500)] + 0.05 * rng.normal(size=(500, 16)), np.repeat(base[:2], 40, axis=0)])
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 16), (901, None), (902, [float("nan")] * 16), (904, [None] + [1.0] * 15)]
    df = spark.createDataFrame(vectors, "det_id long, embedding array<double>")
    refs = df.withColumnRenamed("det_id", "ref_id")
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    want = set()
    for d in range(len(x)):
        sims = np.round((unit[d] * unit).sum(1), 12)
        want |= {(d, int(r), n + 1) for n, r in enumerate(np.lexsort((np.arange(len(x)), -sims))[:3]) if sims[r] >= 0.8}
    show = lambda **o: {(r.det_id, r.ref_id, r.rank) for r in identity.match_identity(df, refs, min_sim=0.8, k=3, **o).collect()}
    monkeypatch.setattr(identity, "BLOCK_ROWS", 100)
    odd = spark.createDataFrame([(2000, [1.0, 2.0])], "ref_id long, embedding array<double>")
    assert show(bank_rows=16, bank_bytes=0) == want == show(bank_rows=16)
    assert {(r.det_id, r.ref_id, r.rank) for r in identity.match_identity(df, refs.union(odd), min_sim=0.8, k=3, bank_rows=16).collect()} == want
    monkeypatch.setattr(identity, "BLOCK_ROWS", 10)
    assert identity.SignCodes.plan(0.8, 0.9, len(vectors))
    near = show(recall=0.9)
    assert len(near & want) >= 0.9 * len(want) and len({(d, r) for d, r, _ in near}) == len(near)


def test_hits_of_a_batch_are_bounded_by_k():
    rng = np.random.default_rng(5)
    q, r = (v / np.sqrt((v * v).sum(1))[:, None] for v in (rng.normal(size=(300, 8)), rng.normal(size=(9000, 8))))
    row, col, sim = identity._best(q, r, -1.0, 3, block=64)
    full = np.round(q @ r.T, 12)
    assert len(row) == 900 and col.tolist() == [c for d in full for c in np.lexsort((np.arange(9000), -d))[:3]]
