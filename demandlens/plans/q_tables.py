"""Registered queries: rules, lemmas and synonyms as tables (P4, P6, X3), chunks across files (M1),
mergeable distinct counts (A2, A3), the versioned collection (S5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demandlens.operators import collection as cl
from demandlens.operators import extract as ex
from demandlens.operators import order as od
from demandlens.operators import retrieval as rt
from demandlens.operators import rules as ru
from demandlens.operators import sketches as sk
from demandlens.operators import text as tx
from demandlens.plans import q_text as qt
from demandlens.plans import sqlbase as S
from demandlens.plans.common import coverage
from demandlens.plans.q_cards import ANALYSED, _item_cards, all_cards
from demandlens.plans.q_extract import PAGES, _pages
from demandlens.plans.registry import ORACLE, register
from demandlens.session import checkpoint_dir, materialize
from demandlens.sources import tables

# --- P4 ---------------------------------------------------------------------------


@register("domain_tags_by_rules", ORACLE["domain_tags"])
def domain_tags_by_rules(spark, sf):
    """The tags of the literal chain, from the same rules as a table joined by rarest trigrams."""
    rules = ru.rule_table(spark, {**qt.PART_DOMAINS, **tx.DOMAIN_KEYWORDS})
    return ru.domains_by_rules(tables.demand_items(spark, sf), rules, "item", "item")


def _benchmark_rules(spark, sf):
    """Every word and every run of two to four words of ``benchmark`` as a keyword: the longer, the earlier
    its rank; its domain is the first item that holds it."""
    toks = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), 0)
    bench = tables.table(spark, sf, "benchmark").select("item_id", toks.alias("t"))
    grams = F.concat("t", *[tx._grams_of(F.col("t"), n) for n in (2, 3, 4)])
    keys = (bench.select("item_id", F.explode(grams).alias("keyword")).groupBy("keyword").agg(F.min("item_id").alias("first"))
            .withColumn("short", -F.length("keyword")))
    ranked = od.global_index(keys, ["short", "keyword"], "rank")
    return ranked.select(F.concat(F.lit("item "), F.col("first").cast("string")).alias("domain"), F.col("rank").cast("long").alias("rank"), "keyword")


@register("question_domains", """
WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark),
k AS (SELECT keyword, min(item_id) AS first FROM (
  SELECT item_id, unnest(t) AS keyword FROM t
  UNION ALL SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' '))) FROM t
  UNION ALL SELECT item_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) FROM t
  UNION ALL SELECT item_id, unnest(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) FROM t)
  GROUP BY keyword),
r AS (SELECT 'item ' || first AS domain, keyword, row_number() OVER (ORDER BY length(keyword) DESC, keyword) - 1 AS rank FROM k),
q AS (SELECT conv_id || ':' || turn AS question, text FROM conversations WHERE role = 'user')
SELECT q.question, coalesce(arg_min(r.domain, r.rank), 'Other') AS domain, arg_min(r.keyword, r.rank) AS keyword
FROM q LEFT JOIN r ON contains(lower(q.text), r.keyword) GROUP BY q.question""")
def question_domains(spark, sf):
    """P4 with a rule table of thousands of keywords drawn from ``benchmark``: the longest keyword inside
    each user question and its domain."""
    q = tables.table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("question"), "text")
    hits = ru.match_rules(q, materialize(_benchmark_rules(spark, sf)), "question", "text")
    return q.select("question").join(hits, "question", "left").select(
        "question", F.coalesce("domain", F.lit(tx.DEFAULT_DOMAIN)).alias("domain"), "keyword")


# --- P6, X3 -----------------------------------------------------------------------

@register("coverage_lemmatised", ORACLE["coverage_normalised"])
def coverage_lemmatised(spark, sf):
    """P1 + P6 + P5: as ``coverage_normalised``, with the lemmas as a table."""
    lemmas = spark.createDataFrame(list(qt.PART_LEMMAS.items()), "word string, lemma string")
    c = ru.lemmatise(coverage(spark, sf), "item", lemmas)
    return c.select("provider", "course", F.col("semester").cast("int"),
                    tx.apply_aliases("item", {**tx.ITEM_ALIASES, **qt.PART_ALIASES}).alias("item"))


_MINED = """
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
tried AS (SELECT word, rule, substr(word, 1, length(word) - length(suffix)) || put AS stem FROM w, (VALUES """ + ", ".join(
    f"({i}, '{s}', '{r}')" for i, (s, r) in enumerate(ru.SUFFIXES)) + f""") v(rule, suffix, put) WHERE suffix(word, suffix)),
lemmas AS (SELECT t.word, arg_min(t.stem, t.rule) AS lemma FROM tried t JOIN w ON w.word = t.stem
           WHERE length(t.stem) >= {ru.MIN_STEM} GROUP BY t.word)"""


def _mined(spark, sf):
    words = tables.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return ru.mine_lemmas(words)


@register("mined_lemmas", "WITH " + _MINED[1:] + " SELECT word, lemma FROM lemmas")
def mined_lemmas(spark, sf):
    """Lemma table mined from the words of all documents by suffix rules."""
    return _mined(spark, sf).select("word", "lemma")


@register("question_lemmas", "WITH " + _MINED[1:] + """,
q AS (SELECT conv_id, turn, text, string_split_regex(lower(trim(text)), '\\s+') AS t FROM conversations WHERE role = 'user'),
p AS (SELECT DISTINCT text, t, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT DISTINCT text, t FROM q)),
j AS (SELECT text, string_agg(coalesce(l.lemma, p.tok), ' ' ORDER BY pos) AS norm FROM p LEFT JOIN lemmas l ON l.word = p.tok
      WHERE p.tok <> '' GROUP BY text)
SELECT q.conv_id, q.turn, CASE WHEN q.text IS NOT NULL THEN coalesce(j.norm, '') END AS lemmas FROM q LEFT JOIN j USING (text)""")
def question_lemmas(spark, sf):
    """Every user question with its words replaced by their mined lemmas."""
    q = tables.table(spark, sf, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    return ru.lemmatise(q, "text", _mined(spark, sf), "lemmas").select("conv_id", "turn", "lemmas")


@register("question_expansions", f"SELECT conv_id, turn, expanded FROM ({ORACLE['question_intents']})")
def question_expansions(spark, sf):
    """As ``question_intents`` expands them, with synonyms and lemmas (here: a final s taken off) as tables."""
    q = tables.table(spark, sf, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", "text", F.concat_ws(":", "conv_id", "turn").alias("question"))
    words = q.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), 0)).alias("word")).distinct()
    lemmas = words.where(F.endswith("word", F.lit("s"))).select("word", F.regexp_replace("word", "s$", "").alias("lemma"))
    return ru.expand_queries(q, "question", "text", ru.synonym_table(spark, tx.QUERY_SYNONYMS), lemmas).select("conv_id", "turn", "expanded")


# --- M1 across files --------------------------------------------------------------

@register("global_chunks", S.with_(PAGES[1:]) + """,
idx AS (SELECT *, row_number() OVER (ORDER BY doc_id, page_no) - 1 AS i FROM pages)
SELECT CAST(floor(i / 3) AS BIGINT) AS chunk_no, count(*) AS n_pages, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       CAST(length(string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY i)) AS INTEGER) AS n_chars,
       md5(string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY i)) AS text_md5
FROM idx GROUP BY ALL""")
def global_chunks(spark, sf):
    """M1: three consecutive kept pages per chunk over all files in order, so that a chunk may hold the end of
    one file and the start of the next."""
    c = ex.global_chunk_pages(_pages(spark, sf))
    return c.select("chunk_no", "n_pages", "first_doc", "last_doc", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# --- A2, A3 -----------------------------------------------------------------------

_CUSTOMERS = """
WITH log AS (SELECT p.p_name || ' ' || lower(p.p_type) AS item, CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_custkey AS customer
             FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""


@register("distinct_estimates", _CUSTOMERS + """
SELECT 'item' AS level, item AS key, count(*) AS n_rows, count(DISTINCT customer) AS n_exact, true AS within_bound FROM log GROUP BY item
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*), count(DISTINCT customer), true FROM log GROUP BY year
UNION ALL SELECT 'all', '', count(*), count(DISTINCT customer), true FROM log""")
def distinct_estimates(spark, sf):
    """A2 + A3: distinct customers per item, per year and over all, estimated from one table of sketches per
    (item, year); each with the exact count and whether the estimate is within four standard errors."""
    li = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = tables.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"))
    part = tables.table(spark, sf, "part").select("p_partkey", tables.item_expr().alias("item"))
    log = (li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
           .select("item", "year", "customer"))
    cube = materialize(sk.sketch_cube(log, "customer"))   # read by all three levels; the log only by the exact counts
    triples = materialize(log.distinct())
    out = None
    for level, keys in (("item", ["item"]), ("year", ["year"]), ("all", [])):
        key = F.concat_ws("", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        est = sk.estimates(cube, keys).select(F.lit(level).alias("level"), key.alias("key"), "estimate", F.col("rows").alias("n_rows"))
        exact = triples.groupBy(*keys).agg(F.count_distinct("customer").alias("n_exact"))
        both = (est.join(exact.select(key.alias("key"), "n_exact"), "key") if keys
                else est.withColumn("n_exact", exact.scalar()))
        both = both.select("level", "key", "n_rows", "n_exact", (
            F.abs(F.col("estimate") - F.col("n_exact")) <= F.ceil(4 * sk.relative_error() * F.col("n_exact"))).alias("within_bound"))
        out = both if out is None else out.unionByName(both)
    return out


# --- S5 ---------------------------------------------------------------------------

@register("collection_rebuild", S.with_(ANALYSED[1:]) + f""",
cards AS (
  SELECT 'skill_card' AS type, 5 AS n_meta FROM analysed
  UNION ALL SELECT 'trajectory_summary', 0 FROM (SELECT DISTINCT tname FROM analysed)
  UNION ALL SELECT 'watch_list', 0 FROM (SELECT 1 FROM analysed WHERE watch_list = 1 AND is_covered = 0 LIMIT 1)
  UNION ALL SELECT 'syllabus_card', 0 FROM (SELECT DISTINCT provider, course FROM coverage)
  UNION ALL SELECT 'gap_summary', 0)
SELECT type, count(*) AS n_cards, {rt.HASH_DIM} AS dim, CAST(sum(n_meta) AS BIGINT) AS n_meta, 2 AS n_versions, true AS failed_rebuild_left_it
FROM cards GROUP BY type""")
def collection_rebuild(spark, sf):
    """The published collection by type (cards, vector length, metadata entries) after a rebuild, and after a
    second one whose ids collide was refused: readers still see the first version."""
    path = f"{checkpoint_dir(spark)}/collection-{uuid.uuid4().hex}"
    cards = materialize(rt.hashed_embedding(all_cards(spark, sf, with_meta=True), "text"))
    first = cl.rebuild(cards, path)
    try:
        cl.rebuild(cards.unionByName(cards.where("type = 'gap_summary'")), path)
        refused = False
    except ValueError:
        refused = cl.current_version(spark, path) == first
    rows = cl.read_collection(spark, path)
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_cards"), F.max(F.size("embedding")).alias("dim"), F.sum(F.size("meta")).cast("long").alias("n_meta"),
        F.lit(len(cl.versions(spark, path))).alias("n_versions"), F.lit(refused).alias("failed_rebuild_left_it"))


@register("item_card_metadata", S.with_(ANALYSED[1:]) + """
SELECT 'skill_' || replace(replace(item, ' ', '_'), '/', '_') AS id, tname AS trajectory, CAST(1 - is_covered AS VARCHAR) AS is_gap,
       CAST(lag AS VARCHAR) AS lag, CAST(watch_list AS VARCHAR) AS watch_list, debt_score FROM analysed""")
def item_card_metadata(spark, sf):
    """The metadata map of every item card, read field by field."""
    c, _, _ = _item_cards(spark, sf)
    m = F.col("meta")
    return c.select("id", *[m[k].alias(k) for k in ("trajectory", "is_gap", "lag", "watch_list")], m["debt_score"].cast("double").alias("debt_score"))
