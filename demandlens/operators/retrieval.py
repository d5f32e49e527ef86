"""Context assembly for a batch of questions.

Every question gets, per card type in its role's quota table, the top
``quota`` cards of that type by cosine (blocked exact search, the type is
part of the block key), re-ranked by the hybrid score; the lists are laid
out in the quota order, de-duplicated on the whole card text (the earliest
position wins), numbered and joined.  A question without any card gets an empty context.

Vectors: the library takes a vector column.  Where none is given, cards and
questions are embedded here by feature hashing of their word tokens (a
stand-in for a sentence-embedding model, which this library does not run).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.operators import cards as cd
from demandlens.operators import text as tx
from demandlens.operators import vectors as vx

# fixed values: retrieval quotas per role, in layout order, and the prompt
QUOTAS = {
    "staff": [("gap_summary", 1), ("trajectory_summary", 1), ("skill_card", 5), ("syllabus_card", 3)],
    "student": [("watch_list", 1), ("trajectory_summary", 1), ("skill_card", 5)],
}
ROLE_OF_CALLER = {"admin": "staff", "staff": "staff", "student": "student"}
DEFAULT_ROLE = "student"
PROMPT_TEMPLATE = ("Use the following retrieved curriculum intelligence data to answer the question.\n"
                   "Answer ONLY from this context. If something is not in the context, "
                   "say: Data not available.\n\n"
                   "--- RETRIEVED CONTEXT ---\n%s\n--- END CONTEXT ---\n\nQuestion: %s")
HASH_DIM = 256


def hash_bucket(token, dim: int):
    """Bucket of a token: the first 32 bits of its md5, modulo ``dim`` (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim


def hashed_embedding(df: DataFrame, text_col: str, out: str = "embedding", dim: int = HASH_DIM) -> DataFrame:
    """Term-count vector of the lower-case word tokens, hashed into ``dim`` buckets; a null text has none."""
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\w+"), 0)
    none = F.array().cast("array<bigint>")
    listed = df.drop(out).withColumn(out, F.coalesce(F.transform(toks, lambda t: hash_bucket(t, dim)), none))

    def count(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            o = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[o[0]:o[-1]]
            row = np.repeat(np.arange(b.num_rows), np.diff(o))
            n = np.bincount(row * dim + flat, minlength=b.num_rows * dim).astype(np.float32)
            vectors = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * dim, pa.array(n))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], b.schema.names)

    schema = T.StructType([*listed.schema.fields[:-1], T.StructField(out, T.ArrayType(T.FloatType()))])
    return listed.mapInArrow(count, schema)


def question_search(questions: DataFrame, cards: DataFrame, k: int = vx.DEFAULT_TOP_K,
                    q_id: str = "question_id", q_text: str = "question", rules=None) -> DataFrame:
    """Plain search: the k nearest cards of every question, inside the card type that its words
    ask for (X4) or among all cards where they ask for none, in hybrid order (V9).

    (question_id, type, id, distance, hybrid_score, hybrid_rank); the type is null without an intent.
    """
    q = questions.select(q_id, tx.intent_of(q_text, rules).alias("type"), tx.expand_query(q_text).alias("_expanded"))
    q = hashed_embedding(q, "_expanded", "query_vec")
    c = cards.select("id", "type", "embedding")
    typed = vx.search(q.where(F.col("type").isNotNull()), c, k, q_id=q_id, type_col="type")
    free = vx.search(q.where(F.col("type").isNull()), c, k, q_id=q_id)
    hits = typed.unionByName(free).join(cards.select("id", "priority_score"), "id")
    ranked = vx.hybrid_rerank(hits, q_id=q_id)
    return ranked.join(q.select(F.col(q_id).cast("string").alias(q_id), "type"), q_id).select(
        q_id, "type", "id", "distance", "hybrid_score", "hybrid_rank")


def assemble_context(questions: DataFrame, cards: DataFrame, role_col: str = "role",
                     q_id: str = "question_id", q_text: str = "question",
                     n_cards: int | None = None) -> DataFrame:
    """C8 + C9: (question_id, n_chunks, context, prompt) per question.

    ``cards`` has (id, type, text, priority_score, embedding); ``questions``
    has (question_id, role, question[, query_vec]).
    """
    role_map = F.create_map(*[F.lit(x) for kv in ROLE_OF_CALLER.items() for x in kv])
    q = questions.withColumn("_role", F.coalesce(F.element_at(role_map, F.lower(F.col(role_col))),
                                                 F.lit(DEFAULT_ROLE)))
    q = q.withColumn("_expanded", tx.expand_query(q_text))
    if "query_vec" not in q.columns:
        q = hashed_embedding(q, "_expanded", "query_vec")
    # the quota table is a map literal: each question explodes its role's (type, quota, order) list
    qmap = F.create_map(*[x for role, qs in QUOTAS.items() for x in (
        F.lit(role), F.array(*[F.struct(F.lit(t).alias("type"), F.lit(n).alias("quota"),
                                         F.lit(i).alias("type_order")) for i, (t, n) in enumerate(qs)]))])
    qt = (q.select(F.col(q_id).alias("_qid"), "query_vec",
                   F.explode(F.element_at(qmap, F.col("_role"))).alias("_q"))
          .select("_qid", "query_vec", "_q.type", "_q.quota", "_q.type_order")
          .withColumn("_key", F.concat_ws("|", F.col("_qid").cast("string"), "type")))
    k = max(n for qs in QUOTAS.values() for _, n in qs)
    # only card types some quota names are scored (a static filter: the quota table is fixed)
    wanted = sorted({t for qs in QUOTAS.values() for t, _ in qs})
    cards = cards.where(F.col("type").isin(*wanted))
    hits = vx.search(qt.select("_key", "type", "query_vec"), cards, k, q_id="_key", c_id="id",
                     c_vec="embedding", type_col="type", n_cards=n_cards, prune_types=False)
    meta = cards.select("id", "text", "priority_score")
    h = hits.join(meta, "id").join(qt.select("_key", "_qid", "quota", "type_order"), "_key")
    # the quota picks by distance, the hybrid score orders inside it
    h = vx.hybrid_rerank(h.where(F.col("rank") <= F.col("quota")), q_id="_key", priority="priority_score")
    # layout position: quota order, then hybrid rank; D9 keeps the earliest of equal texts
    h = h.withColumn("_pos", F.struct("type_order", "hybrid_rank"))
    first = (h.groupBy("_qid", F.sha2("text", 256).alias("_text"))
             .agg(F.min_by(F.struct("_pos", "hybrid_score", "text"), "_pos").alias("c")))
    per_q = first.groupBy("_qid").agg(F.array_sort(F.collect_list("c")).alias("_l"))
    numbered = F.transform("_l", lambda c, i: F.format_string(
        "[%d] (hybrid_score=%s) %s", i + 1, cd.fmt(c["hybrid_score"], 3), c["text"]))
    out = per_q.select(F.col("_qid").alias(q_id), F.size("_l").alias("n_chunks"),
                       F.array_join(numbered, "\n\n").alias("context"))
    asked = questions.select(q_id, q_text).join(out, q_id, "left")
    return asked.withColumn("context", F.coalesce("context", F.lit(""))).select(
        q_id, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "context",
        F.format_string(PROMPT_TEMPLATE, F.col("context"), F.col(q_text)).alias("prompt"))
