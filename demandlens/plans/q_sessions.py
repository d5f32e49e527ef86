"""Registered queries: question log (H1-H3).

Binding: conversations(conv_id, turn, role, text) is the message history;
events(user_id, event_type, ts) is the question log with key
``user_id:event_type`` and a 2-day lifetime (the log spans 30 days).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import sessions as se
from demandlens.plans.registry import register
from demandlens.sources import tables

TAIL_N = 3
TTL_SECONDS = 2 * 24 * 3600


@register("session_tail", f"""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r <= {TAIL_N}""")
def session_tail(spark, sf):
    """H2: the last three messages of every conversation."""
    c = tables.table(spark, sf, "conversations")
    t = se.session_tail(c, TAIL_N, session="conv_id", position="turn")
    return t.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register("short_queries", """
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(pos AS INTEGER) AS pos,
       (lower(trim(q)) IN ('hi', 'hello', 'hey')
        OR len(string_split_regex(lower(trim(q)), '\\s+')) <= 2) AS is_simple
FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[.\\n]+')) AS q,
             generate_subscripts(string_split_regex(text, '[.\\n]+'), 1) - 1 AS pos
      FROM conversations WHERE role = 'user') WHERE trim(q) <> ''""")
def short_queries(spark, sf):
    """H3: whether each sentence of a user turn, asked by itself, takes the short path
    (greeting or ≤ 2 words)."""
    c = tables.table(spark, sf, "conversations").where(F.col("role") == "user")
    q = c.select("conv_id", "turn", F.posexplode(F.split("text", r"[.\n]+")).alias("pos", "q")).where(F.trim("q") != "")
    return q.select("conv_id", "turn", "pos", se.is_simple_query("q").alias("is_simple"))


def question_log(spark, sf):
    ev = tables.table(spark, sf, "events")
    return ev.select(se.cache_key(F.col("user_id").cast("string"), "event_type").alias("key"),
                     "event_id", "ts")


@register("answer_reuse", f"""
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || lower(trim(event_type)) AS key, event_id, ts,
         row_number() OVER (PARTITION BY CAST(user_id AS VARCHAR) || ':' || lower(trim(event_type))
                            ORDER BY ts, event_id) AS rn
  FROM events),
fold(key, rn, event_id, ts, hit, entry_ts) AS (
  SELECT key, rn, event_id, ts, false, ts FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.event_id, e.ts,
         epoch_us(e.ts) - epoch_us(f.entry_ts) <= {TTL_SECONDS * 1000000},
         CASE WHEN epoch_us(e.ts) - epoch_us(f.entry_ts) <= {TTL_SECONDS * 1000000} THEN f.entry_ts ELSE e.ts END
  FROM fold f JOIN ev e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT key, event_id, hit, entry_ts FROM fold""")
def answer_reuse(spark, sf):
    """H1: per question, whether an answer cached at most 2 days earlier is reused."""
    r = se.answer_reuse_ranged(question_log(spark, sf), TTL_SECONDS)
    return r.select("key", "event_id", "hit", "entry_ts")


@register("reuse_rate", f"""
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || lower(trim(event_type)) AS key, event_id, ts,
         row_number() OVER (PARTITION BY CAST(user_id AS VARCHAR) || ':' || lower(trim(event_type))
                            ORDER BY ts, event_id) AS rn
  FROM events),
fold(key, rn, ts, hit, entry_ts) AS (
  SELECT key, rn, ts, false, ts FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.ts,
         epoch_us(e.ts) - epoch_us(f.entry_ts) <= {TTL_SECONDS * 1000000},
         CASE WHEN epoch_us(e.ts) - epoch_us(f.entry_ts) <= {TTL_SECONDS * 1000000} THEN f.entry_ts ELSE e.ts END
  FROM fold f JOIN ev e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT split_part(key, ':', 2) AS event_type, count(*) AS n_questions,
       count(*) FILTER (WHERE hit) AS n_hits FROM fold GROUP BY ALL""")
def reuse_rate(spark, sf):
    """H1 + A10: questions and cache hits per question type."""
    r = se.answer_reuse_ranged(question_log(spark, sf), TTL_SECONDS)
    return (r.groupBy(F.split("key", ":").getItem(1).alias("event_type"))
            .agg(F.count(F.lit(1)).alias("n_questions"), F.count_if("hit").alias("n_hits")))
