import math

import pytest
from pyspark.sql import functions as F

import framelens.functions as fl
from framelens.functions import Box


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def doubles(*items):
    return F.array(*(F.lit(float(i)) for i in items))


def points(*pairs):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pairs))


def test_vectors(spark):
    assert value(spark, fl.l2_normalize(doubles(3, 4))) == pytest.approx([0.6, 0.8])
    assert value(spark, fl.cosine(doubles(1, 0), doubles(1, 0))) == pytest.approx(1.0)
    assert value(spark, fl.cosine(doubles(0, 0), doubles(1, 0))) is None
    with pytest.raises(Exception, match="near-zero"):
        value(spark, fl.l2_normalize(doubles(0, 0), on_zero="error"))
    assert value(spark, fl.bhattacharyya(doubles(1, 2, 3), doubles(2, 4, 6))) == pytest.approx(0.0, abs=1e-7)
    assert value(spark, fl.bhattacharyya(doubles(1, 0), doubles(0, 1))) == pytest.approx(1.0)


def test_boxes(spark):
    a, b = Box.lit(0, 0, 10, 10), Box.lit(5, 5, 15, 15)
    assert value(spark, fl.bbox_iou(a, b)) == pytest.approx(25 / 175)
    assert value(spark, fl.bbox_iou(Box.lit(3, 3, 3, 3), Box.lit(3, 3, 3, 3))) == 0.0
    assert value(spark, fl.bbox_area(Box.lit(5, 5, 1, 9))) == 0.0
    assert value(spark, fl.association_score(a, Box.lit(500, 500, 510, 510), F.lit(0.9))) is None
    assert value(spark, fl.bbox_visible(Box.lit(-9, 0, 0, 5), 80, 80)) is False
    empty = fl.pad_bbox(Box.lit(-50, -50, -40, -40), 0.1, 80, 80)
    assert value(spark, F.struct(*empty)) == (None, None, None, None)


def test_pose_and_landmarks(spark):
    assert value(spark, F.struct(*fl.pose_from_kps(points((1, 1), (2, 2))))) == (0.0, 0.0)
    yaw, pitch = value(spark, F.struct(*fl.pose_from_kps(points((20, 25), (40, 25), (30, 35), (22, 45), (38, 45)))))
    assert yaw == pytest.approx(0.0) and pitch == pytest.approx((35 - (25 + 0.52 * 20)) / 20 * 55)
    assert value(spark, fl.landmark_confidence(F.array().cast("array<double>"))) == 1.0
    assert value(spark, fl.landmark_error(points((0, 0)), points((0, 0)))) is None
    assert value(spark, fl.pose_opacity(F.lit(0.1), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.28)
    assert value(spark, fl.pose_opacity(F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 0.0
    quarter = F.array(doubles(0, -1, 0), doubles(1, 0, 0), doubles(0, 0, 1))
    assert value(spark, fl.euler_from_matrix(quarter))["roll"] == pytest.approx(90.0)


def test_masked_error_needs_an_outside(spark):
    assert value(spark, fl.masked_mae(doubles(1, 5), doubles(3, 5), doubles(0, 1))) == pytest.approx(2.0)
    assert value(spark, fl.masked_mae(doubles(1, 5), doubles(3, 5), doubles(1, 1))) is None


def test_crossfade_stays_inside_zero_and_one(spark):
    for overlap in (1, 5, 17):
        weights = [
            value(spark, fl.crossfade_weight(F.lit(o), F.lit(overlap))) for o in (0, overlap // 2, overlap - 1)
        ]
        assert all(0 < w < 1 for w in weights) and weights == sorted(weights)
    assert value(spark, fl.crossfade_weight(F.lit(0), F.lit(1))) == pytest.approx(0.5 - 0.5 * math.cos(math.pi / 2))


def test_names_and_tokens(spark):
    assert value(spark, fl.manifest_path(F.lit("a/b.c/clip.final.mp4"))) == "clip.final.manifest.json"
    assert value(spark, fl.manifest_path(F.lit(".hidden"))) == ".hidden.manifest.json"
    assert value(spark, fl.output_name(F.lit("out/clip"))) == "out/clip.mp4"
    assert value(spark, fl.parse_size(F.lit("832*480"))) == (832, 480)
    good = value(spark, fl.normalize_tokens(F.lit(" Flash_Attention,math,flash"), {"flash_attention": "flash"}, ["flash", "math"]))
    assert good["tokens"] == ["flash", "math"] and good["valid"]
    assert not value(spark, fl.normalize_tokens(F.lit("gpu"), {}, ["flash"]))["valid"]


def test_cache_key_follows_its_inputs(spark):
    key = lambda size: value(spark, fl.cache_key({"size": F.lit(size), "fps": F.lit(16)}))
    assert key("832*480") == key("832*480") != key("1280*720")
    assert len(key("832*480")) == 32
