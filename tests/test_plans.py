"""Plan shape of the scale-critical operators on small inputs (the registered
queries' plans are checked in test_oracle.py, one build per query)."""

import numpy as np

from demandlens.operators import cooccur as co
from demandlens.operators import extract as ex
from demandlens.operators import features as fe
from demandlens.operators import vectors as vx
from tests.plan_checks import assert_plan_shape, physical_plan


def test_pair_counts_join_on_basket_tiles(spark):
    bi = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "basket long, item string")
    df = co.pair_counts(bi)
    assert_plan_shape("pair_counts", df)
    plan = physical_plan(df)
    # the self-join is an equi-join on (basket, tile pair), followed by a partial aggregation
    assert "HashAggregate" in plan and "partial_count" in plan


def test_top_k_windows_get_group_limits(spark):
    bi = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "basket long, item string")
    plan = physical_plan(co.top_neighbours(co.pair_counts(bi), 3))
    assert "WindowGroupLimit" in plan


def test_blocked_search_has_no_pair_rows(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=4).astype(float).tolist()) for i in range(20)],
                              "vec_id long, embedding array<double>")
    df = vx.semantic_neighbours(v, "vec_id", n=2, block_rows=8)
    assert_plan_shape("semantic_neighbours", df)
    assert "FlatMapGroupsInPandas" in physical_plan(df)


def test_keep_first_is_an_aggregate_not_a_window(spark):
    rows = spark.createDataFrame([("c", "x", 2, "p"), ("c", "x", 1, "q")],
                                 "course string, item string, semester int, provider string")
    plan = physical_plan(ex.dedup_rows(rows, order="semester"))
    assert "min_by" in plan and "Window [" not in plan


def test_cube_is_partially_aggregated(spark):
    d = spark.createDataFrame([("c", 2021, "r", "x", "T", 0)],
                              "company string, year int, role string, item string, item_type string, "
                              "upcoming_flag int")
    plan = physical_plan(fe.demand_cube(d))
    assert "partial_count" in plan
