"""Scans of the Parquet test tables and their binding to the demand/coverage model.

Binding (fixed for this repository):

* demand rows   = lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part
  - basket      = o_orderkey, line = l_linenumber
  - company     = n_name (via c_nationkey)
  - year        = year(o_orderdate)
  - role        = c_mktsegment
  - item        = p_name || ' ' || lower(p_type)
  - item_type   = l_returnflag
  - upcoming_flag = 1 when p_type = 'PROMO'
* coverage rows = part WHERE p_size <= 12 (``max_semester``)
  - provider = lower(trim(p_brand)), course = p_type, semester = p_size, item as above
* focal provider = 'brand#1'

Only the columns each consumer needs are selected, so Parquet scans read a
pruned schema and the semester predicate is pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

FOCAL_PROVIDER = "brand#1"
# item_type values (return flags) named as the three trajectories; R is "upcoming"
TRAJECTORY_NAMES = {"A": "Traditional", "N": "Transitional", "R": "Upcoming"}
UPCOMING_TYPE = "R"
MAX_SEMESTER = 12   # a catalogue row's p_size is its semester; rows beyond this one are no courses


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def item_expr(name: str = "p_name", type_: str = "p_type") -> Column:
    return F.concat(F.col(name), F.lit(" "), F.lower(F.col(type_)))


def demand_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level demand log: one row per line item.

    Join order is written out: orders ⋈ customer ⋈ nation first (orders is
    a quarter of lineitem; nation is a fixed 25-row dimension that the
    planner broadcasts by its size estimate), then lineitem on the order key,
    then part on the part key.  Each join is an equi-join, so the big ones are
    shuffle joins on their keys (or co-located when the tables are bucketed).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", item_expr().alias("item"),
        (F.col("p_type") == "PROMO").cast("int").alias("upcoming_flag"))

    oc = (orders.join(cust, orders.o_custkey == cust.c_custkey)
          .join(nation, F.col("c_nationkey") == nation.n_nationkey)
          .select("o_orderkey", "year", F.col("n_name").alias("company"),
                  F.col("c_mktsegment").alias("role")))
    rows = li.join(oc, li.l_orderkey == oc.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    return rows.select(
        F.col("o_orderkey").alias("basket"),
        F.col("l_linenumber").alias("line"),
        "company", "year", "role", "item",
        F.col("l_returnflag").alias("item_type"),
        "upcoming_flag",
    )


def demand_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct demanded items: distinct part keys of lineitem, then part.  Every line item has its
    order, customer and nation (asserted in the tests), so those joins would change nothing."""
    keys = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    part = table(spark, sf_dir, "part").select("p_partkey", item_expr().alias("item"))
    return keys.join(part, keys.l_partkey == part.p_partkey).select("item").distinct()


def demand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item) of every line item, from lineitem and part alone."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", item_expr().alias("item"))
    return li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("basket"), "item")


def coverage_catalogue(spark: SparkSession, sf_dir: str, max_semester: int | None = MAX_SEMESTER) -> DataFrame:
    """Coverage rows (provider, semester, course, item) from ``part``; max_semester None: all rows."""
    part = table(spark, sf_dir, "part")
    return (part.filter(F.lit(True) if max_semester is None else F.col("p_size") <= max_semester)
            .select(F.lower(F.trim("p_brand")).alias("provider"),
                    F.col("p_size").alias("semester"),
                    F.col("p_type").alias("course"),
                    item_expr().alias("item")))

