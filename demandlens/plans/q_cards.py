"""Registered queries: retrieval cards (C1-C5, C7) over the analysed items."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import cards as cd
from demandlens.operators import retrieval as rt
from demandlens.operators.coverage import provider_count
from demandlens.plans import analytics as an
from demandlens.plans import sqlbase as S
from demandlens.plans.common import FOCAL, coverage, demand
from demandlens.plans.q_learn import hashed_counts_sql
from demandlens.plans.q_scoring import PAIRS, SCORED
from demandlens.plans.q_text import PART_STOP_WORDS, QUESTION_INTENTS
from demandlens.plans.q_text import _KW_SQL as KW_SQL
from demandlens.plans.registry import ORACLE, register
from demandlens.session import materialize
from demandlens.sources import tables

FOCAL_UP = FOCAL.upper()
NAMES = tables.TRAJECTORY_NAMES


def fmt_sql(x: str, d: int) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(38,10)), {d}) AS DECIMAL(38,{d})) AS VARCHAR)"


_TNAME = "CASE trajectory " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + \
    " ELSE trajectory END"

ANALYSED = SCORED + "," + PAIRS[1:].replace("demand AS (", "demand2 AS (", 1).replace(
    "FROM demand)", "FROM demand2)") + """,
recv AS (
  SELECT e.neighbour AS item, sum(CAST(s.gap_prob AS DECIMAL(28,10)) * e.weight) * 0.3 AS s
  FROM edges e JOIN scored s ON s.item = e.item AND s.is_covered = 0 GROUP BY e.neighbour),
topn AS (
  SELECT item, string_agg(neighbour, ', ' ORDER BY r) AS top_cooccurring FROM (
    SELECT item, neighbour, row_number() OVER (PARTITION BY item ORDER BY weight DESC, neighbour) AS r
    FROM edges) WHERE r <= 3 GROUP BY item),
analysed AS (
  SELECT s.*, CAST(round(coalesce(r.s, 0.0), 4) AS DOUBLE) AS propagated_gap,
         coalesce(t.top_cooccurring, '') AS top_cooccurring, """ + _TNAME + """ AS tname
  FROM scored s LEFT JOIN recv r USING (item) LEFT JOIN topn t USING (item))"""

ITEM_TEXT = ("'Skill: ' || item || '. Trajectory: ' || tname || '. Status: ' || "
             f"CASE WHEN is_covered = 1 THEN 'currently taught at {FOCAL_UP}' "
             f"ELSE 'NOT taught at {FOCAL_UP} — curriculum gap' END || "
             "'. Demanded by ' || company_spread || ' of ' || (SELECT n FROM ncomp) || "
             "' companies, total frequency ' || freq || '. Trend slope: ' || " + fmt_sql("trend_slope", 2) +
             " || '. Velocity: ' || " + fmt_sql("velocity", 2) + " || '. Curriculum Lag Index: ' || lag || "
             "' years. Priority Score: ' || " + fmt_sql("priority_score", 3) + " || '. Debt Score: ' || " +
             fmt_sql("debt_score", 3) + " || '.' || ' Missing from ' || ((SELECT p FROM nprov) - taught_count) "
             "|| '/' || (SELECT p FROM nprov) || ' institutes.' || "
             "coalesce(CASE WHEN watch_list = 1 THEN ' On the Early Warning Watch List.' END, '') || "
             "coalesce(CASE WHEN in_transition = 1 THEN ' Transitioning: ' || transition || '.' END, '') || "
             "coalesce(CASE WHEN top_cooccurring <> '' THEN ' Co-occurs with: ' || top_cooccurring || '.' END, '') || "
             "coalesce(CASE WHEN propagated_gap > 0 THEN ' Propagated gap score: ' || " +
             fmt_sql("propagated_gap", 3) + " || '.' END, '')")


def _analysed(spark, sf):
    """The analysed item table, written once to the checkpoint folder: every card
    branch reads the same small table instead of re-running the graph plan."""
    d = demand(spark, sf)
    return materialize(an.analysed_items(d, coverage(spark, sf), FOCAL, baskets=tables.demand_baskets(spark, sf))), d


def _table_values(items):
    """Company count and year bounds, read from the checkpointed item table (not the log)."""
    return (items.select(F.max("n_companies")).scalar(), items.select(F.min("year_lo")).scalar(),
            items.select(F.max("year_hi")).scalar())


def _item_cards(spark, sf):
    items, d = _analysed(spark, sf)
    ncomp, _, _ = _table_values(items)
    return cd.item_cards(items, FOCAL, ncomp, provider_count(coverage(spark, sf)), NAMES), items, d


@register("item_cards", S.with_(ANALYSED[1:]) + f"""
SELECT 'skill_' || replace(replace(item, ' ', '_'), '/', '_') AS id, 'skill_card' AS type,
       {ITEM_TEXT} AS text, priority_score FROM analysed""")
def item_cards(spark, sf):
    """One text card per item (status, demand, trend, lag, scores, optional clauses)."""
    c, _, _ = _item_cards(spark, sf)
    return c.select("id", "type", "text", "priority_score")


TRAJECTORY_SQL = (f""",
st AS (SELECT tname, count(*) AS n, count(*) FILTER (WHERE is_covered = 0) AS g,
              avg(lag) AS l, avg(priority_score) AS p FROM analysed GROUP BY tname),
tp AS (SELECT tname, string_agg(item, ', ' ORDER BY r) AS top FROM (
         SELECT tname, item, row_number() OVER (PARTITION BY tname ORDER BY priority_score DESC, item) AS r
         FROM analysed WHERE is_covered = 0) WHERE r <= 5 GROUP BY tname)""", f"""
SELECT 'trajectory_' || lower(st.tname) AS id, 'trajectory_summary' AS type,
       'Trajectory group: ' || st.tname || '. ' ||
       CASE st.tname {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cd.TRAJECTORY_DESCRIPTIONS.items())} ELSE '' END
       || ' ' || st.n || ' total skills, ' || st.g || ' not taught at {FOCAL_UP}. Average CLI: ' ||
       {fmt_sql('st.l', 1)} || ' years. Average Priority Score: ' || {fmt_sql('st.p', 3)} ||
       '. Top gap skills by priority: ' || coalesce(tp.top, '') || '.' AS text,
       CAST(NULL AS DOUBLE) AS priority_score
FROM st LEFT JOIN tp USING (tname)""")


@register("trajectory_cards", S.with_(ANALYSED[1:]) + "".join(TRAJECTORY_SQL))
def trajectory_cards(spark, sf):
    """One summary card per trajectory group."""
    items, _ = _analysed(spark, sf)
    return cd.trajectory_cards(items, FOCAL, NAMES)


WATCH_SQL = f""",
wl AS (SELECT * FROM analysed WHERE watch_list = 1 AND is_covered = 0)
SELECT 'watch_list_{FOCAL}' AS id, 'watch_list' AS type,
       'Early Warning Watch List for {FOCAL_UP} — ' || count(*) ||
       ' emerging skills not yet mainstream but rising fast. Faculty should plan additions now. ' ||
       'Skills ranked by urgency: ' ||
       string_agg(item || ' (urgency ' || {fmt_sql('watch_urgency', 3)} || ', ' || company_spread ||
                  ' companies, ' || tname || ')', ' | ' ORDER BY watch_urgency DESC, item) || '.' AS text,
       CAST(NULL AS DOUBLE) AS priority_score
FROM wl HAVING count(*) > 0"""


@register("watch_card", S.with_(ANALYSED[1:]) + WATCH_SQL)
def watch_card(spark, sf):
    """The watch-list card (absent when nothing is watched)."""
    items, _ = _analysed(spark, sf)
    return cd.watch_card(items, FOCAL, NAMES)


COVERAGE_CARDS_SQL = """
SELECT 'syllabus_' || provider || '_' || replace(course, ' ', '_') AS id, 'syllabus_card' AS type,
       'Institute: ' || upper(provider) || '. Course: ' || course || ' (Semester ' ||
       first(semester ORDER BY item, semester) || '). Skills taught: ' ||
       string_agg(item, ', ' ORDER BY item, semester) || '. Total: ' || count(*) || ' skills.' AS text,
       CAST(NULL AS DOUBLE) AS priority_score
FROM coverage GROUP BY provider, course"""


@register("coverage_cards", S.with_(S.COVERAGE[1:]) + COVERAGE_CARDS_SQL)
def coverage_cards(spark, sf):
    """C4: one card per (provider, course)."""
    return cd.coverage_cards(coverage(spark, sf))


GAP_SQL = f""",
g AS (SELECT * FROM analysed WHERE is_covered = 0)
SELECT 'gap_summary_{FOCAL}' AS id, 'gap_summary' AS type,
       '{FOCAL_UP} curriculum gap summary. ' || (SELECT count(*) FROM g) || ' of ' ||
       (SELECT count(*) FROM analysed) || ' industry skills are not taught at {FOCAL_UP}. Data from ' ||
       (SELECT n FROM ncomp) || ' companies, ' || (SELECT lo FROM bounds) || '-' || (SELECT hi FROM bounds) ||
       '. Top 10 by Priority Score: ' ||
       coalesce((SELECT string_agg(item, ', ' ORDER BY priority_score DESC, item) FROM
                 (SELECT * FROM g ORDER BY priority_score DESC, item LIMIT 10)), '') ||
       '. Top 10 by Debt Score: ' ||
       coalesce((SELECT string_agg(item, ', ' ORDER BY debt_score DESC, item) FROM
                 (SELECT * FROM g ORDER BY debt_score DESC, item LIMIT 10)), '') ||
       '. Skills in transition: ' ||
       coalesce((SELECT string_agg(item, ', ' ORDER BY item) FROM g WHERE in_transition = 1), 'none') ||
       '. Average CLI: ' || {fmt_sql('(SELECT avg(lag) FROM g)', 1)} ||
       ' years. Total curriculum debt: ' || {fmt_sql('(SELECT sum(debt_score) FROM g)', 2)} || '.' AS text,
       CAST(NULL AS DOUBLE) AS priority_score"""


@register("gap_summary_card", S.with_(ANALYSED[1:]) + GAP_SQL)
def gap_summary_card(spark, sf):
    """The one gap summary card."""
    items, _ = _analysed(spark, sf)
    ncomp, lo, hi = _table_values(items)
    return cd.gap_summary_card(items, FOCAL, ncomp, lo, hi)


def all_cards(spark, sf, with_meta=False):
    """Every card of the collection (C1-C5), from one analysed item table."""
    c, items, _ = _item_cards(spark, sf)
    ncomp, lo, hi = _table_values(items)
    return cd.all_cards(c, cd.trajectory_cards(items, FOCAL, NAMES), cd.watch_card(items, FOCAL, NAMES),
                        cd.coverage_cards(coverage(spark, sf)),
                        cd.gap_summary_card(items, FOCAL, ncomp, lo, hi), with_meta)


@register("card_inventory", S.with_(ANALYSED[1:]) + f""",
cards AS (
  SELECT 'skill_card' AS type FROM analysed
  UNION ALL SELECT 'trajectory_summary' FROM (SELECT DISTINCT tname FROM analysed)
  UNION ALL SELECT 'watch_list' FROM (SELECT 1 FROM analysed WHERE watch_list = 1 AND is_covered = 0 LIMIT 1)
  UNION ALL SELECT 'syllabus_card' FROM (SELECT DISTINCT provider, course FROM coverage)
  UNION ALL SELECT 'gap_summary')
SELECT type, count(*) AS n_cards FROM cards GROUP BY type""")
def card_inventory(spark, sf):
    """Cards per type in the whole collection."""
    return cd.card_inventory(all_cards(spark, sf))


def _cte(sql: str) -> str:
    """The body of a card query that begins with further CTEs, as (CTEs, last SELECT)."""
    at = sql.rindex("\nSELECT '")
    return sql[:at], sql[at:]


_WATCH, _GAP = _cte(WATCH_SQL), _cte(GAP_SQL)
CARDS = ANALYSED + TRAJECTORY_SQL[0] + _WATCH[0] + _GAP[0] + f""",
cards AS (
  SELECT 'skill_' || replace(replace(item, ' ', '_'), '/', '_') AS id, 'skill_card' AS type, {ITEM_TEXT} AS text, priority_score FROM analysed
  UNION ALL {TRAJECTORY_SQL[1]}
  UNION ALL {_WATCH[1]}
  UNION ALL {COVERAGE_CARDS_SQL}
  UNION ALL {_GAP[1]}),
questions AS (SELECT conv_id || ':' || turn AS question_id, CASE WHEN turn = 0 THEN 'staff' ELSE 'student' END AS role, text AS question,
                     expanded, intent FROM ({ORACLE['question_intents']}) JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') USING (conv_id, turn)),
cv AS ({hashed_counts_sql('cards', 'id', 'text', rt.HASH_DIM)}),
qv AS ({hashed_counts_sql('questions', 'question_id', 'expanded', rt.HASH_DIM)}),
cn AS (SELECT id, sqrt(sum(n * n)) AS l FROM cv GROUP BY id),
qn AS (SELECT question_id, sqrt(sum(n * n)) AS l FROM qv GROUP BY question_id),
dots AS (SELECT question_id, id, sum(q.n * c.n) AS d FROM qv q JOIN cv c USING (bucket) GROUP BY ALL),
sims AS (SELECT q.question_id, q.role, q.intent, c.id, c.type, c.text, c.priority_score, 1 - coalesce(d.d / (qn.l * cn.l), 0.0) AS distance
         FROM questions q CROSS JOIN cards c LEFT JOIN dots d ON d.question_id = q.question_id AND d.id = c.id
         LEFT JOIN qn ON qn.question_id = q.question_id LEFT JOIN cn ON cn.id = c.id)"""

_QUOTAS = ", ".join(f"('{role}', '{t}', {n}, {i})" for role, ts in rt.QUOTAS.items() for i, (t, n) in enumerate(ts))
_HYBRID = "round(0.7 * (1.0 - distance) + 0.3 * coalesce(priority_score, 0.0), 4)"


@register("context_assembly", S.with_(CARDS[1:]) + f""",
quotas(role, type, quota, type_order) AS (VALUES {_QUOTAS}),
near AS (SELECT s.*, quota, type_order, row_number() OVER (PARTITION BY question_id, s.type ORDER BY distance, id) AS r
         FROM sims s JOIN quotas USING (role, type)),
hyb AS (SELECT *, {_HYBRID} AS hybrid FROM near WHERE r <= quota),
pos AS (SELECT *, row_number() OVER (PARTITION BY question_id, type ORDER BY hybrid DESC, r) AS hr FROM hyb),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, text ORDER BY type_order, hr) AS k FROM pos) WHERE k = 1),
num AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY type_order, hr) AS i FROM first),
ctx AS (SELECT question_id, count(*) AS n, string_agg('[' || i || '] (hybrid_score=' || {fmt_sql('hybrid', 3)} || ') ' || text,
               chr(10) || chr(10) ORDER BY i) AS context FROM num GROUP BY question_id)
SELECT q.question_id, CAST(coalesce(n, 0) AS INTEGER) AS n_chunks, coalesce(context, '') AS context,
       'Use the following retrieved curriculum intelligence data to answer the question.' || chr(10) ||
       'Answer ONLY from this context. If something is not in the context, say: Data not available.' || chr(10) || chr(10) ||
       '--- RETRIEVED CONTEXT ---' || chr(10) || coalesce(context, '') || chr(10) || '--- END CONTEXT ---' || chr(10) || chr(10) ||
       'Question: ' || question AS prompt
FROM questions q LEFT JOIN ctx USING (question_id)""")
def context_assembly(spark, sf):
    """V8 + V9 + D9 + C8 + C9: retrieval context and prompt for every user question of the
    conversation log, over the whole card collection (hashed word vectors; who opens a
    conversation asks as admin, later turns as student)."""
    # the cards are counted, searched and joined back: written once
    cards = materialize(rt.hashed_embedding(all_cards(spark, sf), "text"))
    conv = tables.table(spark, sf, "conversations").where(F.col("role") == "user")
    qs = conv.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"),
                     F.when(F.col("turn") == 0, "admin").otherwise("student").alias("role"),
                     F.col("text").alias("question"))
    return rt.assemble_context(qs, cards)


@register("question_search", S.with_(CARDS[1:]) + f""",
near AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS r FROM sims WHERE intent IS NULL OR type = intent),
hyb AS (SELECT *, {_HYBRID} AS hybrid_score FROM near WHERE r <= 8)
SELECT question_id, intent AS type, id, round(distance, 9) AS distance, hybrid_score,
       CAST(row_number() OVER (PARTITION BY question_id ORDER BY hybrid_score DESC, r) AS INTEGER) AS hybrid_rank FROM hyb""")
def question_search(spark, sf):
    """X3 + X4 + V8 + V9: the eight best cards of every user question, inside its inferred type."""
    from demandlens.operators import text as tx

    cards = materialize(rt.hashed_embedding(all_cards(spark, sf), "text"))
    conv = tables.table(spark, sf, "conversations").where(F.col("role") == "user")
    qs = conv.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    found = rt.question_search(qs, cards, rules=[*tx.INTENT_FILTERS, *QUESTION_INTENTS])
    return found.withColumn("distance", F.round("distance", 9)).withColumn("hybrid_rank", F.col("hybrid_rank").cast("int"))


@register("enriched_item_cards", S.with_(ANALYSED[1:]) + f""",
kw AS (SELECT item, {KW_SQL} AS keywords FROM analysed),
tok AS (SELECT trajectory, unnest(string_split(k, ', ')) AS tok FROM
          (SELECT trajectory, {KW_SQL} AS k FROM analysed)),
cnt AS (SELECT trajectory, tok, count(*) AS n FROM tok WHERE tok <> '' GROUP BY ALL),
th AS (SELECT trajectory, string_agg(tok, ' / ' ORDER BY r) AS theme FROM (
         SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY n DESC, tok) AS r FROM cnt)
       WHERE r <= 4 GROUP BY trajectory)
SELECT 'skill_' || replace(replace(a.item, ' ', '_'), '/', '_') AS id,
       {ITEM_TEXT} || ' ' || concat_ws(' ',
           CASE WHEN coalesce(kw.keywords, '') <> '' THEN 'Keywords: ' || kw.keywords || '.' END,
           CASE WHEN coalesce(th.theme, '') NOT IN ('', 'unknown') THEN 'Skill cluster theme: ' || th.theme || '.' END)
       AS text
FROM analysed a JOIN kw USING (item) LEFT JOIN th ON th.trajectory = a.trajectory""")
def enriched_item_cards(spark, sf):
    """Item cards with their keywords (P7) and the theme of their trajectory group."""
    from demandlens.operators import text as tx

    c, items, _ = _item_cards(spark, sf)
    kw = items.select("item", "trajectory", tx.keywords("item", PART_STOP_WORDS).alias("keywords"))
    themes = tx.top_tokens(kw, "trajectory", "keywords", 4)
    extras = kw.join(themes, "trajectory", "left").select("item", "keywords", "theme")
    return cd.enrich_item_cards(c, extras).select("id", "text")
