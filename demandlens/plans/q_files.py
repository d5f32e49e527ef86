"""Registered queries: CSV and folder sources and sinks (S1-S3, P1-P3) over files written from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demandlens.plans import sqlbase as S
from demandlens.plans.common import demand
from demandlens.plans.registry import register
from demandlens.session import checkpoint_dir
from demandlens.sources import files, tables

END = "\x1e\x1d"   # what the writer puts behind a text, in place of a line end

# The md5 of a row's key decides what is wrong with its line: its first digit 0 spoils the number, 1 blanks the item.


def _digit(*key):
    return F.substring(F.md5(F.concat_ws(":", *key)), 1, 1)


@register("csv_round_trip", S.with_(S.DEMAND[1:]) + """,
d AS (SELECT *, substr(md5(basket || ':' || line), 1, 1) AS h FROM demand),
c AS (SELECT *, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 1) AS h FROM part)
SELECT 'demand' AS source, 'kept' AS outcome, count(*) AS n, CAST(sum(year) AS BIGINT) AS total,
       count(*) FILTER (WHERE item_type = 'R') AS n_upcoming, count(DISTINCT item) AS n_items FROM d WHERE h NOT IN ('0', '1')
UNION ALL SELECT 'demand', 'year', count(*), NULL, NULL, NULL FROM d WHERE h = '0'
UNION ALL SELECT 'demand', 'item', count(*), NULL, NULL, NULL FROM d WHERE h = '1'
UNION ALL SELECT 'demand', 'fields', count(*), NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'coverage', 'kept', count(*), CAST(sum(p_size) AS BIGINT), NULL, count(DISTINCT lower(p_name || ' ' || p_type)) FROM c WHERE h NOT IN ('0', '1')
UNION ALL SELECT 'coverage', 'semester', count(*), NULL, NULL, NULL FROM c WHERE h = '0'
UNION ALL SELECT 'coverage', 'item', count(*), NULL, NULL, NULL FROM c WHERE h = '1'""")
def csv_round_trip(spark, sf):
    """S1 + S2 + P1-P3: the demand log and all parts as coverage written as CSV (some lines spoiled, some with too few
    fields), read by declared schemas; rows kept and rejected by reason, and sums over what was kept."""
    folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    h = _digit("basket", "line")
    kind = F.when(F.col("item_type") == "R", " UPCOMING").otherwise(F.col("item_type"))
    rows = demand(spark, sf).select(
        F.col("company").alias("Company"), F.when(h == "0", "n/a").otherwise(F.col("year").cast("string")).alias("Year"),
        F.col("role").alias("Role"), F.when(h == "1", "  ").otherwise(F.concat(F.lit(" "), F.upper("item"))).alias("Skill"), kind.alias("Skill_Type"))
    short = tables.table(spark, sf, "supplier").select(F.col("s_name").alias("Company"), F.lit("2000").alias("Year"))
    part = tables.table(spark, sf, "part")
    g = _digit("p_partkey")
    taught = part.select(F.col("p_brand").alias("Institute"), F.when(g == "0", "five").otherwise(F.col("p_size").cast("string")).alias("Semester"),
                         F.col("p_type").alias("Course"), F.when(g == "1", "").otherwise(tables.item_expr()).alias("Skill"))
    files.write_table(rows, f"{folder}/demand/whole", "csv")
    files.write_table(short, f"{folder}/demand/short", "csv")
    files.write_table(taught, f"{folder}/coverage/whole", "csv")

    def summed(source, kept, rejected, total, upcoming):
        none = F.lit(None).cast("long")
        return kept.agg(F.count(F.lit(1)).alias("n"), F.sum(total).cast("long").alias("total"), upcoming.alias("n_upcoming"),
                        F.count_distinct("item").alias("n_items")).select(F.lit(source).alias("source"), F.lit("kept").alias("outcome"), "*").unionByName(
            rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(source).alias("source"), F.col("reason").alias("outcome"), "n", none.alias("total"), none.alias("n_upcoming"), none.alias("n_items")))

    return (summed("demand", *files.demand_with_rejects(spark, f"{folder}/demand/*"), "year", F.sum("upcoming_flag").cast("long"))
            .unionByName(summed("coverage", *files.coverage_with_rejects(spark, f"{folder}/coverage/*"), "semester", F.max(F.lit(None).cast("long")))))


@register("folder_pages", """
SELECT CAST(doc_id AS VARCHAR) AS name, length(text) AS n_chars, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def folder_pages(spark, sf):
    """S3: one file per document, written to a folder and read back by name: whole texts."""
    folder = f"{checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
    docs = tables.table(spark, sf, "documents").where(F.col("text").isNotNull())
    # the writer ends every text with the given separator
    written = files.write_text_files(docs.select(F.col("doc_id").cast("string").alias("name"), "text"), folder, END)
    read = files.read_text_files(spark, written, "*.txt", recursive=True)
    whole = F.get(F.split("text", END), F.lit(0))   # behind its end nothing is left
    return read.select(files.file_name("path").alias("name"), F.length(whole).cast("long").alias("n_chars"), F.md5(whole).alias("text_md5"))
