"""Invariants of splits and merges, ontology edge cases, streams and plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelloom.operators import catalog, checks, hierarchy, joins, mapping, merge_split, search, stats
from labelloom.plans.views import Views
from labelloom.streaming import checks as streams
from tests.conftest import SF


@pytest.mark.parametrize("n", [0, 1, 2, 7, 90, 101])
def test_random_split_sizes(spark, n):
    images = spark.range(n).select("id")
    out = {r.split: r["count"] for r in merge_split.random_split(images, digits=1).groupBy("split").count().collect()}
    assert out.get("train", 0) == int(n * 0.7) and out.get("validation", 0) == int(n * 0.15)
    assert sum(out.values()) == n
    kept = merge_split.random_split(images, at_least_one=True, digits=1).where("split = 'train'").count()
    assert kept == (max(1, int(n * 0.7)) if n else 0)


def test_split_is_stable_and_seeded(spark):
    images = spark.range(200).select("id")
    ids = lambda df: {r.id for r in df.where("split = 'test'").collect()}
    assert ids(merge_split.random_split(images)) == ids(merge_split.random_split(images.repartition(13), digits=1))
    assert ids(merge_split.random_split(images)) != ids(merge_split.random_split(images, seed=1))


def test_ratio_checks():
    merge_split.check_ratios(0.7, 0.15, 0.15)
    merge_split.check_ratios(0.5, 0.1, 0.1, exact=False)
    for bad in ((0.7, 0.2, 0.2), (0.5, 0.1, 0.1), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            merge_split.check_ratios(*bad)


def test_small_strata_reach_train_and_validation(spark):
    strata = spark.createDataFrame([(i, "big") for i in range(40)] + [(100, "one"), (200, "two"), (201, "two")], "id long, stratum string")
    out = merge_split.stratified_split(strata, digits=1)
    by = {(r.stratum, r.split): r["count"] for r in out.groupBy("stratum", "split").count().collect()}
    assert by[("one", "train")] == 1 and by[("two", "train")] == 1 and by[("two", "validation")] == 1
    assert by[("big", "train")] == 28 and by[("big", "validation")] == 6


def test_merge_count_is_sum_less_dropped(spark):
    rows = [("a", 0, 1, "p1"), ("a", 0, 2, "p2"), ("b", 1, 1, "p1"), ("b", 1, 2, "other"), ("c", 2, 2, "third"), ("c", 2, 3, "p3")]
    resolved = merge_split.resolve_collisions(spark.createDataFrame(rows, "source string, place int, id long, file_path string"))
    got = {(r.source, r.id): (r.fate, r.new_id) for r in resolved.collect()}
    assert got == {
        ("a", 1): ("kept", "1"), ("a", 2): ("kept", "2"), ("b", 1): ("dropped", None), ("b", 2): ("renamed", "merged_2_b"),
        ("c", 2): ("renamed", "merged_2_c"), ("c", 3): ("kept", "3"),
    }


def test_imbalance_of_one_class(spark):
    counts = spark.createDataFrame([("d", "only", 5)], "dataset string, class_name string, n long")
    r = stats.imbalance(counts).first()
    assert (r.import_ratio, r.quality_ratio, r.managed_ratio) == (0.0, 1.0, 1.0)
    assert stats.diversity(counts).first().diversity == 0.0
    assert stats.long_tail(counts).first().long_tail_ratio == 1.0


def test_mapping_cascade_order(spark):
    nodes = hierarchy.build_tree(spark.createDataFrame([("car.sedan",), ("car.van",), ("ship.ferry",)], "value string"))
    rules = spark.createDataFrame(
        [("r1", "d", "Sedan", "car.sedan", 0.8, 1), ("r2", "d", "sedan", "car.van", 0.6, 2), ("r3", "d", "lorry", "gone.value", 0.5, 3)],
        "rule_id string, dataset_name string, source_label string, canonical_value string, confidence double, created_at long",
    )
    aliases = spark.createDataFrame([("car.van", "minibus", "alias"), ("ship.ferry", "minibus", "synonym"), ("nowhere.x", "boat", "alias")], "canonical_value string, alias string, kind string")
    patterns = spark.createDataFrame([("^fer.*z$", "ship.ferry", 0.75)], "pattern string, canonical_value string, confidence double")
    labels = spark.createDataFrame([(x,) for x in ("Sedan", "SEDAN", "minibus", "sedans", "FERryz", "ferr", "boat", "Ferry", "")], "label string")
    got = {r.label: r for r in mapping.map_labels(labels, rules, nodes, aliases, patterns).collect()}
    assert (got["Sedan"].canonical_value, got["Sedan"].confidence, got["Sedan"].match_type) == ("car.sedan", 0.8, "exact")
    assert got["SEDAN"].confidence == pytest.approx(0.76) and got["SEDAN"].match_type == "case_insensitive"
    assert (got["minibus"].canonical_value, got["minibus"].match_type, got["minibus"].alternatives) == ("car.van", "alias", ["ship.ferry"])
    assert (got["sedans"].confidence, got["sedans"].match_type) == (0.85, "synonym")
    assert got["FERryz"].confidence == 0.75
    assert got["ferr"].tier == 4 and got["ferr"].canonical_value == "ship.ferry"
    assert (got["boat"].canonical_value, got["boat"].canonical_name, got["boat"].confidence) == ("unknown_object", "Unknown Object", 0.0)
    assert got["Ferry"].confidence == 1.0 and got["Ferry"].match_type == "alias"
    assert got[""].canonical_value == "unknown_object"


@pytest.mark.parametrize("per_chunk", [1, 3, 500])
def test_regex_chunks_give_the_same(spark, per_chunk):
    labels = spark.createDataFrame([(f"item{i}",) for i in range(30)], "label string")
    rules = spark.createDataFrame([(f"M{i}$", f"v{i}", 0.7) for i in range(8)] + [("^ITEM1", "start", 0.5)], "pattern string, canonical_value string, confidence double")
    got = {(r.label, r.canonical_value) for r in joins.regex_matches(labels, rules, per_chunk).collect()}
    assert got == {(f"item{i}", f"v{i}") for i in range(8)} | {(f"item{i}", "start") for i in [1, *range(10, 20)]}


def test_contains_join_equals_nested_loop(spark):
    words = ["a", "re", "red", "green", "een tr", "zzz", "", "é", "n t"]
    texts = ["green tree", "red", "a", "tree green", "", "café", "reed"]
    got = {(r.w, r.t) for r in joins.contains_join(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == {(w, t) for w in words for t in texts if w and w in t}


def test_keyword_score_counts_repeated_query_words(spark):
    docs = spark.createDataFrame([(1, "blue red car"), (2, "red"), (3, "a b")], "doc_id long, body string")
    queries = spark.createDataFrame([(1, "red red car x"), (2, "!!"), (3, "b")], "query_id long, query string")
    got = search.keyword_search(search.keyword_index(docs, ["body"]), queries).collect()
    assert sorted((r.query_id, r.doc_id, r.score) for r in got) == [(1, 1, 3 * (1 + 2 / 4 * 1.5)), (1, 2, 2 * (1 + 1 / 4 * 1.5))]


def test_index_is_stored_bucketed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 5} common") for i in range(50)], "doc_id long, body string")
    spark.sql("DROP TABLE IF EXISTS keyword_index")
    search.keyword_index(docs, ["body"]).write.option("path", str(tmp_path / "idx")).bucketBy(4, "token").sortBy("token").mode("overwrite").saveAsTable("keyword_index")
    stored = spark.table("keyword_index")
    plan = stored.groupBy("token").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    found = search.keyword_search(stored, spark.createDataFrame([(1, "word3")], "query_id long, query string"), 3)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [3, 8, 13]
    spark.sql("DROP TABLE keyword_index")


def test_unknown_sizes_raise_no_image_issue(spark):
    images = spark.createDataFrame([("d", 1, None, 10, None, None), ("d", 2, 16, 16, "bmp", "grayscale")], "dataset string, id long, width int, height int, format string, color_space string")
    assert sorted(r.rule for r in checks.image_issues(images).collect()) == ["tiny", "wrong_color_space", "wrong_format"]


def test_streamed_issues_equal_batch(spark, tmp_path):
    images = Views(spark, SF).images
    images.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), images.schema, 1)
    query = streams.append_issues(streams.image_issues(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = checks.image_issues(images)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def test_streamed_reliability_equals_batch(spark, tmp_path):
    fetches = spark.createDataFrame([(i % 3, i % 4 != 0) for i in range(60)], "source_id long, success boolean")
    fetches.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), fetches.schema, 1)
    query = streams.source_reliability(stream).writeStream.format("memory").queryName("reliability").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(spark.table("reliability")) == rows(catalog.source_reliability(fetches))


def test_scan_reads_only_what_is_asked(spark):
    text = entry.queries()["f11_resolution_buckets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    best = entry.queries()["c03_sources_by_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in best


def test_timestamps_do_not_matter_for_registry_order(spark):
    from labelloom.operators import registry

    log = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1, "x", False), ("a", dt.datetime(2024, 1, 2), 2, "y", True), ("b", dt.datetime(2024, 1, 1), 3, "z", False)], "k string, ts timestamp, n long, v string, deleted boolean")
    assert [tuple(r) for r in registry.latest(log, ["k"], ["ts", "n"], ["v"], "deleted").collect()] == [("b", "z", 1)]
