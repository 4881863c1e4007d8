"""Cases of the findings of round 4."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from labelloom.plans import catalogue
from tests.compare import connect, difference, duck_rows, spark_rows
from tests.conftest import SF


def test_derived_measures_round_like_sql(spark, duck, tmp_path):
    """Extents that are no small whole numbers: ties, large and tiny ratios, none at all."""
    sizes = [1 + n / d for d in (2, 640, 1280, 3200, 9600, 1_000_000) for n in range(-3, 90)]
    sizes += [(1.1 + n) * 10.0**e for n in range(30) for e in (-9, -4, 9, 13, 18, 26, 200)]
    sizes += [1.0, 0.0, -3.5, 1 + 2.0**-52, None, float("nan"), float("inf"), float("-inf"), 1e308]
    rows = [(7 * i + s, i % 200 + 1, None if i % 50 == 0 else 37 * i + 11 * s - 40, s, q) for i, q in enumerate(sizes) for s in (1, 2, 3)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    lines.selectExpr("*", "0.05D l_discount", "10D l_extendedprice").coalesce(1).write.parquet(f"{tmp_path}/lines")
    next((tmp_path / "lines").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    (tmp_path / "part.parquet").symlink_to(f"{SF}/part.parquet")
    name = "g09_derived_measures"
    found = spark_rows(catalogue().callables()[name](spark, str(tmp_path)))
    assert len(found[1]) > 2000
    assert difference(found, duck_rows(connect(tmp_path), catalogue().sql[name])) is None


def test_merged_coco_files_stay_where_they_are_numbered(spark, monkeypatch):
    """The result reads stored rows and small tables; nothing is shuffled by file again."""
    from labelloom.sources import merge

    monkeypatch.setattr(merge, "TURN_ROWS", 5000)
    found = catalogue().callables()["k05_merged_coco"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(source_file" not in plan and "SortMergeJoin" not in plan
    assert difference(spark_rows(found), duck_rows(connect(SF), catalogue().sql["k05_merged_coco"])) is None


def test_coco_files_merge_alike_in_ranges_turns_and_joins(spark, monkeypatch):
    """Repeated and missing ids, files without names or images, images without annotations."""
    from labelloom.sources import merge

    files = [None, "", *[f"f{k:02}" for k in range(40)]]
    images = [(f, i, f"{f}-{n}", 10 * n, n) for k, f in enumerate(files) if k % 4 for i, n in (("1", 2), ("1", 1), ("2", k), (None, 4))]
    boxes = [(f, str(a % 5), i, c, [float(a), 1.0, 2.0 + k], 1.5 if a % 2 else None, None) for k, f in enumerate(files) if k % 5 for a, (i, c) in enumerate((i, c) for i in ("1", "2", "3", None) for c in ("1", "9", None))]
    names = [(f, c, n, s) for k, f in enumerate(files) if k % 3 for c, n, s in (("1", f"n{k % 7}", None), ("1", f"n{k % 6}", "s"), ("2", "all", "t"), (None, "none", None), ("4", None, "u"))]
    parts = (
        spark.createDataFrame(images, "source_file string, id string, file_name string, width int, height int"),
        spark.createDataFrame(boxes, "source_file string, id string, image_id string, category_id string, bbox array<double>, area double, iscrowd int"),
        spark.createDataFrame(names, "source_file string, id string, name string, supercategory string"),
    )

    def merged():
        return [sorted(map(str, df.collect())) for df in merge.merge_coco(*parts)]

    whole = merged()
    assert [len(rows) for rows in whole] == [len(images), len(boxes), len(merge.merge_coco(*parts)[2].collect())]
    monkeypatch.setattr(merge, "TURN_ROWS", 200)
    monkeypatch.setattr(merge, "TURNS", 3)
    assert merged() == whole
    monkeypatch.setattr(merge, "FILE_ROWS", 5)
    assert merged() == whole


def test_stored_rows_leave_no_shuffle_files(spark):
    from labelloom.session import discard, stored

    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = place.getAllFiles().size()
    kept = stored(spark.range(1000).repartition(7, "id"), "kept")
    assert place.getAllFiles().size() <= before and kept.count() == 1000
    discard(kept)
    assert not spark._jvm.java.io.File(kept.stored_at).exists()


def coco_of(spark, n):
    images = spark.range(1, n + 1).select(F.col("id").alias("coco_id"), F.lit("a.jpg").alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    boxes = spark.range(1, 3 * n + 1).select(
        F.col("id").alias("coco_id"), (F.col("id") % n + 1).alias("coco_image_id"), F.lit(1).alias("category_id"),
        *[F.lit(1.0).alias(c) for c in ("x", "y", "width", "height", "area")], F.lit(0).alias("iscrowd"),
    )
    return images, boxes, spark.range(1, 2).select("id", F.lit("c").alias("name"), F.lit("object").alias("supercategory"))


def test_coco_document_is_made_from_small_parts_alone(spark, tmp_path, monkeypatch):
    """When the document takes its place, its lines are gone and its parts are compressed."""
    from labelloom.session import discard
    from labelloom.sources import files, writers

    target, seen = tmp_path / "all.json", []

    def spent(df):
        discard(df)
        parts = [p for p in (tmp_path / "all.json.parts").rglob("*") if p.is_file()]
        seen.append((Path(df.stored_at).exists(), target.exists(), (tmp_path / "all.json.parts/document").exists(), sum(p.stat().st_size for p in parts)))

    monkeypatch.setattr(files, "discard", spent)
    size = writers.write_coco_document(*coco_of(spark, 5000), str(target))
    assert [s[:3] for s in seen] == [(False, False, False)] and seen[0][3] < size / 4
    found = json.loads(target.read_text())
    assert target.stat().st_size == size and [[e["id"] for e in found[k]] for k in ("images", "annotations", "categories")] == [[*range(1, 5001)], [*range(1, 15001)], [1]]


def test_split_coco_shuffles_boxes_once(spark, tmp_path):
    from labelloom.sources import readers, writers

    writers.write_coco_document(*coco_of(spark, 50), f"{tmp_path}/all.json")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        found = readers.read_coco(spark, f"{tmp_path}/all.json", split=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" in plan
        assert found.where("file_name = 'a.jpg' AND class_name = 'c'").count() == 150
    finally:
        spark.conf.set(limit, before)
