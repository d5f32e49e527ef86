"""Registered queries: page text → chunks → prompts, dictionary extraction.

Binding: a document is a file and each of its lines is a page.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demandlens.operators import extract as ex
from demandlens.plans import sqlbase as S
from demandlens.plans.common import FOCAL, coverage
from demandlens.plans.registry import register
from demandlens.session import checkpoint_dir, materialize
from demandlens.sources import tables


def _pages(spark, sf):
    return ex.kept_pages(ex.document_pages(tables.table(spark, sf, "documents")))


PAGES = """
pages AS (
  SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, trim(text) AS text FROM (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no,
           unnest(string_split(text, chr(10))) AS text FROM documents)
  WHERE length(trim(text)) > 100)"""

CHUNKS = PAGES + """,
idx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS i FROM pages),
chunks AS (
  SELECT doc_id, CAST(floor(i / 3) AS INTEGER) AS chunk_no, count(*) AS n_pages,
         CAST(min(page_no) AS INTEGER) AS first_page,
         string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_no) AS text
  FROM idx GROUP BY ALL)"""


@register("kept_pages", S.with_(PAGES[1:]) + """
SELECT doc_id, page_no, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM pages""")
def kept_pages(spark, sf):
    """Pages (document lines) longer than 100 characters after trimming."""
    p = _pages(spark, sf)
    return p.select("doc_id", F.col("page_no").cast("int"), F.length("text").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


@register("page_chunks", S.with_(CHUNKS[1:]) + """
SELECT doc_id, chunk_no, n_pages, first_page, CAST(length(text) AS INTEGER) AS n_chars,
       md5(text) AS text_md5 FROM chunks""")
def page_chunks(spark, sf):
    """M1: three consecutive kept pages per chunk, joined by the page-break marker."""
    c = ex.chunk_pages(_pages(spark, sf))
    return c.select("doc_id", "chunk_no", "n_pages", F.col("first_page").cast("int"),
                    F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


DICTIONARY = S.ITEMS + """,
dict AS (
  SELECT lower(trim(item)) AS item FROM items
  UNION SELECT unnest(regexp_extract_all(lower(text), '[\\w.+#/-]+')) FROM benchmark
  UNION SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
        FROM (SELECT regexp_extract_all(lower(text), '[\\w.+#/-]+') AS t FROM benchmark))"""


def dictionary(spark, sf):
    """Demanded items, and all words and word pairs of the benchmark texts."""
    t = F.regexp_extract_all(F.lower("text"), F.lit(ex.TOKEN), 0)
    bench = tables.table(spark, sf, "benchmark").select(t.alias("t"))
    pairs = bench.select(F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p"))
    return (tables.demand_items(spark, sf).unionByName(bench.select(F.explode("t").alias("item")))
            .unionByName(pairs.where(F.col("p.b").isNotNull()).select(F.concat_ws(" ", "p.a", "p.b").alias("item"))).distinct())


def _mentions_sql(src: str, page: str) -> str:
    gram = "unnest(list_transform(range(1, len(t) - {0}), lambda i: array_to_string(t[i:i + {1}], ' ')))"
    return f"""
tk AS (SELECT doc_id, {page} AS page_no, regexp_extract_all(lower(text), '[\\w.+#/-]+') AS t FROM {src}),
grams AS (
  SELECT DISTINCT doc_id, page_no, g FROM (
    SELECT doc_id, page_no, unnest(t) AS g FROM tk
    UNION ALL SELECT doc_id, page_no, {gram.format(0, 1)} FROM tk
    UNION ALL SELECT doc_id, page_no, {gram.format(1, 2)} FROM tk
    UNION ALL SELECT doc_id, page_no, {gram.format(2, 3)} FROM tk)),
hits AS (SELECT g.doc_id, g.page_no, d.item FROM grams g JOIN dict d ON d.item = g.g)"""


_PROMPT_SQL = ("'Extract all course-skill pairs from this syllabus text.' || chr(10) || chr(10) || "
               "'For reference, examples of relevant technical skills include:' || chr(10) || r || "
               "chr(10) || chr(10) || 'SYLLABUS TEXT:' || chr(10) || substring(text, part_no * 4000 + 1, 4000) || "
               "chr(10) || chr(10) || 'Output ONLY a JSON array like:' || chr(10) || "
               "'[{\"institute\":\"" + FOCAL.upper() + "\",\"semester\":5,\"course\":\"Computer Networks\","
               "\"skill\":\"networking\"}]'")


@register("chunk_prompts", S.with_(CHUNKS[1:], DICTIONARY) + "," + _mentions_sql("chunks", "chunk_no") + f""",
ref AS (SELECT doc_id, page_no AS chunk_no, string_agg(item, ', ' ORDER BY item) AS r FROM hits GROUP BY ALL),
parts AS (SELECT c.doc_id, c.chunk_no, c.text, coalesce(ref.r, '') AS r,
                 unnest(range(greatest(1, CAST(ceil(length(c.text) / 4000) AS BIGINT)))) AS part_no
          FROM chunks c LEFT JOIN ref USING (doc_id, chunk_no))
SELECT doc_id, chunk_no, CAST(part_no AS INTEGER) AS part_no, CAST(length({_PROMPT_SQL}) AS INTEGER) AS n_chars,
       md5({_PROMPT_SQL}) AS prompt_md5
FROM parts""")
def chunk_prompts(spark, sf):
    """The extraction prompts of every chunk: parts of at most 4,000 characters, with the
    dictionary entries that the chunk mentions as reference."""
    p = ex.prompt_batch(materialize(ex.chunk_pages(_pages(spark, sf))), dictionary(spark, sf), FOCAL)
    return p.select("doc_id", "chunk_no", "part_no", F.length("prompt").alias("n_chars"),
                    F.md5("prompt").alias("prompt_md5"))


ALL_PAGES = """
allpages AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no,
         unnest(string_split(text, chr(10))) AS text FROM documents)"""


@register("dictionary_mentions", S.with_(ALL_PAGES[1:], DICTIONARY) + "," + _mentions_sql("allpages", "page_no") + """
SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, item FROM hits""")
def dictionary_mentions(spark, sf):
    """M4: dictionary entries found as whole token sequences in all pages."""
    docs = tables.table(spark, sf, "documents")
    once = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return ex.dictionary_mentions(ex.document_pages(docs), dictionary(spark, sf), "item", unique=once) \
        .select("doc_id", F.col("page_no").cast("int"), "item")


# --- replies: parse, recover, overlay, republish ------------------------------------
# One chunk per part row, of two pages (name and type).  The first hex digit of the md5 of its key
# says what the model answered: 0 an object without its item, 1 no JSON, 2-3 JSON in a code fence,
# 4 a semester out of range, 5 one in words, else plain JSON.  A retried page is answered
# with JSON unless the md5 of key and page number starts with a digit below 8.

_KIND = "substr(md5(CAST(p_partkey AS VARCHAR)), 1, 1)"
_RETRY = "substr(md5(p_partkey || ':' || part_no), 1, 1) >= '8'"
PARSED = f"""
parsed AS (
  SELECT p_partkey AS chunk_no, '{FOCAL}' AS provider,
         CASE WHEN {_KIND} IN ('4', '5') THEN 0 ELSE p_size END AS semester, p_type AS course, lower(p_name) AS item
  FROM part WHERE {_KIND} NOT IN ('0', '1'))"""


def _chunks_of_parts(spark, sf):
    part = tables.table(spark, sf, "part")
    return part.select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("chunk_no"), "p_name", "p_type", "p_size",
                       F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 1).alias("kind"),
                       F.concat_ws(ex.PAGE_BREAK, "p_name", "p_type").alias("text"))


def _replies(chunks):
    kind = F.col("kind")
    semester = F.when(kind == "4", "99999999999").when(kind == "5", "five").otherwise(F.col("p_size").cast("string"))
    whole = F.create_map(F.lit("institute"), F.lit("any"), F.lit("semester"), semester,
                         F.lit("course"), F.concat(F.lit(" "), "p_type"), F.lit("skill"), F.upper("p_name"))
    obj = F.when(kind == "0", F.map_filter(whole, lambda k, v: k != "skill")).otherwise(whole)
    plain = F.to_json(F.array(obj))
    reply = (F.when(kind == "1", F.lit("I found no table in this text."))
             .when(kind.isin("2", "3"), F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise(plain))
    return chunks.select("doc_id", "chunk_no", reply.alias("reply"))


def _parsed(spark, sf):
    return ex.parse_replies(_replies(_chunks_of_parts(spark, sf)), FOCAL)


@register("parsed_replies", S.with_(PARSED[1:]) + "SELECT chunk_no, provider, semester::INTEGER AS semester, course, item FROM parsed")
def parsed_replies(spark, sf):
    """M2: coverage rows of the model's replies (fences, broken and incomplete ones among them)."""
    return _parsed(spark, sf).select("chunk_no", "provider", "semester", "course", "item")


RECOVERED = f"""
recovered AS (
  SELECT p_partkey AS chunk_no, part_no, lower(trim(CASE part_no WHEN 0 THEN p_name ELSE p_type END)) AS item
  FROM part, range(2) r(part_no) WHERE {_KIND} IN ('0', '1') AND {_RETRY})"""


def _recovered(spark, sf):
    chunks = _chunks_of_parts(spark, sf)
    failed = ex.failed_chunks(chunks.select("doc_id", "chunk_no", "text"), _parsed(spark, sf))
    pages = ex.split_chunks(failed)
    digit = F.substring(F.md5(F.concat_ws(":", "chunk_no", "part_no")), 1, 1)
    obj = F.create_map(F.lit("institute"), F.lit("any"), F.lit("semester"), F.lit("1"), F.lit("course"), F.lit("Retry"), F.lit("skill"), F.col("text"))
    again = pages.select("doc_id", "chunk_no", "part_no", F.when(digit >= "8", F.to_json(F.array(obj))).otherwise("none").alias("reply"))
    return ex.parse_replies(again, FOCAL)


@register("recovered_chunks", S.with_(RECOVERED[1:]) + f"""
SELECT p_partkey AS chunk_no, (SELECT count(*) FROM recovered r WHERE r.chunk_no = p_partkey) AS n_recovered
FROM part WHERE {_KIND} IN ('0', '1')""")
def recovered_chunks(spark, sf):
    """M3: every chunk whose reply gave no rows, split into its pages and asked again: rows won."""
    failed = ex.failed_chunks(_chunks_of_parts(spark, sf).select("doc_id", "chunk_no"), _parsed(spark, sf))
    rows = _recovered(spark, sf).groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n"))
    return failed.join(rows, "chunk_no", "left").select("chunk_no", F.coalesce("n", F.lit(0)).alias("n_recovered"))


OVERLAID = PARSED + "," + RECOVERED + f""",
every AS (SELECT provider, semester, course, item FROM parsed
          UNION ALL SELECT '{FOCAL}', 1, 'Retry', item FROM recovered),
firsts AS (SELECT course, item, min(semester) AS semester FROM every WHERE length(item) > 1 GROUP BY ALL),
overlaid AS (SELECT '{FOCAL}' AS provider, semester::INTEGER AS semester, course, item FROM firsts
             UNION SELECT '{FOCAL}', 0, 'Manual', lower(r_name) FROM region)"""


def _overlaid(spark, sf):
    rows = _parsed(spark, sf).unionByName(_recovered(spark, sf).drop("part_no")).drop("doc_id", "chunk_no")
    manual = tables.table(spark, sf, "region").select(
        F.lit(FOCAL).alias("provider"), F.lit(0).alias("semester"), F.lit("Manual").alias("course"), F.lower("r_name").alias("item"))
    return ex.overlay(ex.dedup_rows(rows, 1, "semester"), manual)


@register("overlaid_coverage", S.with_(OVERLAID[1:]) + "SELECT provider, semester, course, item FROM overlaid")
def overlaid_coverage(spark, sf):
    """M5 + M6: parsed and recovered rows, first per (course, item), with the manual rows laid over."""
    return _overlaid(spark, sf).select("provider", "semester", "course", "item")


@register("republished_coverage", S.with_(OVERLAID[1:], S.COVERAGE) + f"""
SELECT provider, count(*) AS n_rows FROM (
  SELECT provider FROM coverage WHERE provider NOT IN ('{FOCAL}', 'brand#2')
  UNION ALL SELECT provider FROM overlaid) GROUP BY provider""")
def republished_coverage(spark, sf):
    """The published catalogue after the focal provider's rows are replaced and those of a
    provider without new rows are removed: rows per provider."""
    path = f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    rows = coverage(spark, sf)
    rows.write.partitionBy("provider").parquet(path)
    ex.republish(rows, _overlaid(spark, sf), path, FOCAL)
    ex.republish(rows, rows.limit(0), path, "brand#2")
    return spark.read.parquet(path).groupBy(F.col("provider").cast("string").alias("provider")).agg(F.count(F.lit(1)).alias("n_rows"))
