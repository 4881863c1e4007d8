"""Findings of round 3 about growth: joins, shuffles and partitions of the named queries."""

from pyspark.sql import functions as F

from labelloom.operators import checks, dedup
from labelloom.plans import catalogue
from tests.conftest import SF


def plan_of(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_duplicate_report_joins_no_rows_to_summaries(spark):
    df = catalogue().callables()["d06_duplicate_report"](spark, SF)
    # Each of the two readers of the annotations joins lines with parts; one join more adds the totals.
    joins = plan_of(df).count("Join Inner")
    assert joins <= 3 and plan_of(df).count("Join LeftOuter") == 1


def test_duplicate_report_counts_equal_rows_as_sql_does(spark):
    images = spark.createDataFrame(
        [("a", 1, "x/p.jpg", "h1", {"k": "v"}), ("a", 2, "y/p.jpg", "", {"k": "w"}), ("a", 3, "y/q.jpg", "h1", None), ("b", 4, None, None, {"k": "v"})],
        "dataset string, id long, file_path string, sha256 string, metadata map<string,string>",
    )
    box = (1.0, 2.0, 3.0, 4.0)
    rows = [
        ("a", 7, 1, "dog", *box), ("a", 7, 1, "dog", *box),  # equal in all columns: one is a copy
        ("a", 8, 2, "dog", *box), ("a", 9, 2, "cat", *box), ("b", 10, 4, "dog", *box),
    ]
    annotations = spark.createDataFrame(rows, "dataset string, id long, image_id long, label string, x double, y double, width double, height double")
    annotations = annotations.select("*", F.lit(None).cast("string").alias("ontology_class"), *[F.lit(0).alias(c) for c in dedup.SEQUENCE])
    found = {r["dataset"]: tuple(r)[1:] for r in dedup.report(images, annotations).collect()}
    # Links: p.jpg and h1 twice, one repeat on image 1, two repeats of the object in "a".
    assert found == {"a": (5, 2, 2, round(2 / 3, 6)), "b": (0, 0, 0, 0.0)}


def test_errors_are_found_without_the_image_join(spark):
    v = catalogue().callables()
    issues = v["v02_annotation_checks"](spark, SF)
    errors = plan_of(issues.where(F.col("severity") == checks.ERROR))
    assert "o_custkey" in plan_of(issues) and "o_custkey" not in errors


def test_shuffle_partitions_grow_with_the_input(spark, monkeypatch):
    from labelloom import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    session.prepare(spark, SF)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = int(spark.conf.get(key))
    monkeypatch.setattr(session, "PARTITION_INPUT", 1000)
    session.prepare(spark, SF)
    assert small >= least and int(spark.conf.get(key)) == -(-session.input_bytes(spark, SF) // 1000) > small
    monkeypatch.undo()
    session.prepare(spark, SF)


def test_keyword_scores_are_added_up_by_document(spark, monkeypatch):
    from labelloom.operators import search

    assert search.parts_for(spark.range(3 << 20), spark.range(100)) == 300
    monkeypatch.setattr(search, "TASK_PAIRS", 100)
    parts = search.parts_for(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    for name in ("r02_keyword_search", "r05_hydrate"):
        plan = plan_of(catalogue().callables()[name](spark, SF), "executedPlan")
        assert f", {parts}), REPARTITION_BY_NUM" in plan


def test_coco_lines_are_made_once(spark, tmp_path, monkeypatch):
    from labelloom.sources import files, writers

    seen = []
    write = files.write_document
    monkeypatch.setattr(files, "write_document", lambda lines, *rest: seen.append(plan_of(lines)) or write(lines, *rest))
    images = spark.range(1, 4).select(F.col("id").alias("coco_id"), F.lit("a.jpg").alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    boxes = spark.range(1, 6).select(
        F.col("id").alias("coco_id"), F.lit(1).alias("coco_image_id"), F.lit(1).alias("category_id"),
        *[F.lit(1.0).alias(c) for c in ("x", "y", "width", "height", "area")], F.lit(0).alias("iscrowd"),
    )
    categories = spark.range(1, 2).select("id", F.lit("c").alias("name"), F.lit("object").alias("supercategory"))
    size = writers.write_coco_document(images, boxes, categories, f"{tmp_path}/all.json")
    import json

    text = (tmp_path / "all.json").read_text()
    found = json.loads(text)
    assert len(text) == size and [[e["id"] for e in found[k]] for k in ("images", "annotations", "categories")] == [[1, 2, 3], [1, 2, 3, 4, 5], [1]]
    assert "to_json" not in seen[0].lower() and "structstojson" not in seen[0].lower()
