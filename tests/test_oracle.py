"""Every registered query against its DuckDB oracle on the smallest test tables,
and the shape of its physical plan (one build per query).

The queries of the llm subpackage have their own tests beside their operators."""

import os

import pytest

from tests.oracle_harness import compare, duck
from tests.plan_checks import MODEL_QUERIES, assert_plan_shape

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def _names():
    from demandlens.plans import registry

    registry.load_all()
    return sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle_and_plan(spark, con, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    if name not in MODEL_QUERIES:
        assert_plan_shape(name, df)
    info = compare(spark, con, name, lambda s, sf: df, E.oracle_sql().get(name), SF)
    assert info["ok"] is not False, info


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns and df.count() >= 0
