"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from labelloom.plans import catalogue
from tests.compare import difference, duck_rows, spark_rows
from tests.conftest import SF

# Those of the training-data subpackage are tested in tests/llm.
PLANS = catalogue().callables()
SQL = dict(catalogue().sql)


def test_every_query_has_sql():
    assert set(SQL) == set(PLANS) <= set(entry.queries())
    assert entry.FLAGSHIP in PLANS


# The only ones that need Python: the header probes and the early-stopping fold.
PYTHON_OK = {"s17_image_headers", "s17_image_files", "w04_early_stopping"}


def check_plan(name, df):
    """No query pairs all rows with all rows or leaves the JVM without need."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name not in PYTHON_OK:
        assert not any(k in text for k in ("ArrowEval", "BatchEvalPython", "InPandas"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = PLANS[name](spark, SF)
    check_plan(name, df)
    assert difference(spark_rows(df), duck_rows(duck, SQL[name])) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "overall" in df.columns
