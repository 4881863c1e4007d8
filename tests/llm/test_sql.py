"""Queries against their SQL on the smallest tables, and shapes of the others."""

import pytest

from labelloom.llm import queries
from tests.compare import difference, duck_rows, spark_rows
from tests.conftest import SF

COLUMNS = {
    "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op6_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op10_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
}


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_equals_sql(spark, duck, name):
    assert difference(spark_rows(queries.queries()[name](spark, SF)), duck_rows(duck, queries.sql()[name])) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = queries.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(found.columns)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op3_line_dedup", "op7_license_scan"])
def test_native_plans_hold_no_python(spark, name):
    text = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(k in text for k in ("ArrowEval", "BatchEvalPython", "InPandas", "InArrow"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
