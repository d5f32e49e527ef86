"""Every query that has SQL against it on the smallest tables; the others run over whole tables."""
import os

import pytest

from demandlens.llm import queries
from tests.oracle_harness import compare, duck

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    info = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert info["ok"], info


def test_all_are_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_suffix_dedup", "op5_ngram_jaccard", "op7_substring_dedup", "op10_pii"])
def test_one_row_per_document(spark, name):
    docs = queries.read(spark, SF, "documents")
    out = queries.QUERIES[name](spark, SF)
    assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and out.count() == docs.count()


def test_native_plans(spark):
    """Operators 2 and 9 run no Python on the executors and no cartesian product."""
    for name in ("op2_decontamination", "op9_poisson_mixing"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name
