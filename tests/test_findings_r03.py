"""Cases of the findings of round 3."""

import json

from pyspark.sql import functions as F

from labelloom.functions.numbers import nearest
from labelloom.operators.skew import join_group_summary, salted_join, stored_row_number
from labelloom.plans import catalogue
from labelloom.sources import readers
from tests.conftest import SF


def query(spark, name):
    return catalogue().callables()[name](spark, SF)


def test_stems_meet_across_data_sets(spark):
    found = query(spark, "j15_stem_join")
    folder = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    assert found.where(folder(F.col("path")) != folder(F.col("other_path"))).count() > 0
    assert "split_part(f.path, '/', 1)" not in catalogue().sql["j15_stem_join"]


def test_coco_rows_of_equal_keys_stay_apart(spark):
    def document(image, width):
        return json.dumps({
            "images": [{"id": i, "file_name": f"{i}.jpg", "width": width, "height": 10} for i in range(image, image + 9)],
            "annotations": [{"id": i, "image_id": i, "category_id": i % 3, "bbox": [1, 1, 2, 2]} for i in range(image - 1, image + 10)],
            "categories": [{"id": 1, "name": "one"}, {"id": 2, "name": f"two{width}"}],
        })

    texts = spark.createDataFrame([(7, document(5, 100)), (7, document(5, 200)), (None, document(50, 300))], "k long, json string")
    found = readers.parse_coco(texts, "json", ["k"]).collect()
    names = {0: "0", 1: "one"}
    expected = []
    for k, image, width in ((7, 5, 100), (7, 5, 200), (None, 50, 300)):
        for i in range(image - 1, image + 10):
            side = width if image <= i < image + 9 else None
            expected.append((k, str(i), side, names.get(i % 3, f"two{width}")))
    assert sorted(map(str, expected)) == sorted(str((r.k, r.annotation_id, r.image_width, r.class_name)) for r in found)


def test_nearest_rounds_like_sql(spark, duck):
    values = [82 / 1280, 621 / 9600, -82 / 1280, 0.5e-6, -0.5e-6, 1.0, 1e300, float("inf"), 0.1234565, None]
    values += [i / d for d in (640, 1280, 3200, 9600) for i in range(-50, 300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.r for r in df.select(nearest(F.col("x")).alias("r")).collect()]
    assert got == [r[0] for r in duck.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]


def test_stored_row_number_takes_one_shuffle(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("w"))
    found = stored_row_number(df, ["v", "w"])
    assert [(r.v, r.rn) for r in found.orderBy("rn").collect()] == [(i, i + 1) for i in range(5000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "[v" not in plan.split("Window")[1].split("\n")[0]


def test_merged_labels_hash_texts_before_the_join(spark):
    plan = query(spark, "k05_merged_labels")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sha2(")  # printed from the top: hashed below the join


def test_few_keys_are_spread(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "a").alias("k"))
    summary = rows.groupBy("k").agg(F.count("*").alias("n"))
    found = join_group_summary(rows, summary, ["k"], "n", ["id"], salts=8)
    assert found.count() == 1000 and {tuple(r) for r in found.select("k", "n").distinct().collect()} == {("a", 500), (None, 500)}
    left = salted_join(rows, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], ["id"], how="left")
    assert left.count() == 1000 and left.where("v IS NULL").count() == 500
    for name in ("u04_huge_objects", "s10_open_images"):
        assert "_salt" in query(spark, name)._jdf.queryExecution().optimizedPlan().toString()


def test_visdrone_sends_numbers_to_the_sizes(spark):
    lines = spark.createDataFrame([("a", "1,2,3,4,1,5"), (None, "NaN,2,3,4,1,5"), ("a", "x,2,3,4,1,5")], "stem string, line string")
    sizes = spark.createDataFrame([("a", 10, 20)], "stem string, image_width int, image_height int")
    df = readers.parse_visdrone(lines, sizes)
    assert sorted(str((r.stem, r.class_id, r.cx)) for r in df.collect()) == ["('a', 4, 0.25)", "(None, 4, nan)"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_left" in plan[plan.index("Join"):]
