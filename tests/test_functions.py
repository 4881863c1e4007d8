"""Edge cases of scalar functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.functions import bins, checksums, confidence, geometry, licenses, numbers, text, versions
from labelloom.functions.geometry import Box


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("r")).first().r


def column_values(spark, data, schema, column):
    return [r.r for r in spark.createDataFrame(data, schema).select(column.alias("r")).collect()]


def test_class_and_file_names(spark):
    names = [("  Traffic Light!! ",), ("red__CAR--x",), ("Überfahrt 3",), ("___",), ("",), (None,)]
    assert column_values(spark, names, "s string", text.class_name(F.col("s"))) == ["traffic_light", "red_carx", "überfahrt_3", "", "", None]
    files = [("a/b/My Photo (1).PNG",), ("x.tar.gz",), ("noext",), (".hidden",), ("A_b.JPEG",)]
    assert column_values(spark, files, "s string", text.file_name(F.col("s"))) == ["my-photo-1.png", "x-tar.jpg", "noext.jpg", "hidden.jpg", "a_b.jpeg"]


def test_singular(spark):
    words = ["puppies", "buses", "boxes", "dishes", "watches", "cars", "glass", "sheep"]
    got = column_values(spark, [(w,) for w in words], "s string", text.singular(F.col("s")))
    assert got == ["puppy", "bus", "box", "dish", "watch", "car", "glass", "sheep"]


def test_similarity_of_empty_is_zero(spark):
    data = [("", "abc"), ("_ ", "abc"), ("abc", "cab"), ("ab", "bc")]
    got = column_values(spark, data, "a string, b string", text.character_similarity(F.col("a"), F.col("b")))
    assert got[:3] == [0.0, 0.0, 1.0] and got[3] == pytest.approx(1 / 3)


def test_corner_formats_guard_zero_size(spark):
    df = spark.createDataFrame(
        [("xywh_absolute", 10, 20), ("xywh_absolute", 0, 20), ("cxcywh_normalized", 0, 0), ("strange", 5, 5)], "f string, w int, h int"
    )
    box = geometry.corners_from(Box(*[F.lit(v) for v in (2.0, 4.0, 6.0, 8.0)]), F.col("f"), F.col("w"), F.col("h"))
    got = [tuple(r) for r in df.select(box.a, box.b, box.c, box.d).collect()]
    assert got == [(0.2, 0.2, 0.8, 0.6), (None, 0.2, None, 0.6), (-1.0, 0.0, 5.0, 8.0), (None, None, None, None)]


def test_polygon_needs_three_points(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 1.0), (2.0, 5.0)],), ([(0.0, 0.0), (1.0, 1.0)],)], "v array<struct<x:double,y:double>>")
    b = geometry.polygon_box(F.col("v"))
    assert [tuple(r) for r in df.select(b.a, b.b, b.c, b.d).collect()] == [(0.0, 0.0, 4.0, 5.0), (None,) * 4]


def test_rotated_quarter_turn(spark):
    b = geometry.rotated_box(*[F.lit(v) for v in (0.0, 0.0, 4.0, 2.0, 90.0)])
    got = spark.range(1).select(b.a, b.b, b.c, b.d).first()
    assert [round(v, 9) for v in got] == [-1.0, -2.0, 2.0, 4.0]


def test_versions_compare_by_number(spark):
    data = [("1.0.10", "1.0.9"), ("1.2", "1.2.0"), ("2", "10.0.0")]
    assert column_values(spark, data, "a string, b string", versions.compare(F.col("a"), F.col("b"))) == [1, 0, -1]
    bumps = column_values(spark, [("1.9.19",), ("1.0.19",), ("1.0.3",), ("bad",)], "a string", versions.rolling_bump(F.col("a")))
    assert bumps == ["2.0.0", "1.1.0", "1.0.4", "1.0.0"]


def test_license_ladders(spark):
    texts = ["CC-BY-4.0", "mit license", "Creative Commons zero", "according to nobody", "All Rights Reserved", "Apache 2", "nothing"]
    got = column_values(spark, [(t,) for t in texts], "t string", licenses.classify(F.col("t")))
    assert got == ["cc_by_4", "mit", "cc0", "cc_by_4", "proprietary", "apache_2", "unknown"]
    whole = column_values(spark, [("according to nobody",), ("permit me",)], "t string", licenses.classify(F.col("t"), whole_word=True))
    assert whole == ["unknown", "unknown"]


def test_reliability_and_grades(spark):
    data = [(0, 0), (0, 9), (3, 1), (5, 0)]
    assert column_values(spark, data, "s long, f long", confidence.reliability(F.col("s"), F.col("f"))) == [0.5, 0.1, 0.75, 1.0]
    assert column_values(spark, [(90.0,), (89.9,), (60.0,), (40.0,), (1.0,)], "x double", bins.letter_grade(F.col("x"))) == list("ABCDF")


def test_map_hash_ignores_order(spark):
    df = spark.range(1).select(
        checksums.of_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("x"),
        checksums.of_map(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("y"),
    )
    r = df.first()
    assert r.x == r.y


def test_directory_hash_depth_only_regroups(spark):
    rows = [("d", f"f{i}", f"h{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, p string, h string")
    flat = checksums.directory(df, ["g"], "p", "h", digits=0).first().directory_sha256
    import hashlib

    assert flat == hashlib.sha256("".join(p + h for _, p, h in sorted(rows)).encode()).hexdigest()
    deep = checksums.directory(df, ["g"], "p", "h", digits=4, step=2).first().directory_sha256
    assert deep != flat and deep == checksums.directory(df.repartition(5), ["g"], "p", "h", digits=4, step=2).first().directory_sha256


def test_fixed6_prints_what_python_prints(spark):
    values = [0.0078125, 0.0003125, 1 / 3, 2.5e-7, 5e-7, 1e-9, -0.5, -1.0000005, 123456.7890125, 0.9999995, 0.1234565, 7 / 3200, 11 / 3200, 0.0000015]
    values += [k / 12000 for k in range(1, 400)] + [k / 3200 for k in range(1, 400)]
    got = column_values(spark, [(v,) for v in values], "x double", numbers.fixed6(F.col("x")))
    assert got == [f"{v:.6f}" for v in values]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_fixed6_on_any_value(spark, values):
    values = [v for v in values if v != 0]
    if values:
        got = column_values(spark, [(float(v),) for v in values], "x double", numbers.fixed6(F.col("x")))
        assert got == [f"{v:.6f}" for v in values]


def test_aspect_of_flat_boxes(spark):
    data = [(0.0, 5.0), (4.0, 0.0), (2.0, 8.0)]
    assert column_values(spark, data, "w double, h double", geometry.aspect_h_over_w(F.col("w"), F.col("h"))) == [math.inf, 0.0, 4.0]
