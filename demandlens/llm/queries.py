"""The registered queries of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import (chat_format, decontam, divergence, embed_dedup, fm_dedup, jaccard, lm_score, mixing, packing, pii,
                            suffix_dedup, toxicity, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "rejected")


@query(decontam.oracle())
def op2_decontamination(spark, sf_dir):
    """Verified overlaps of documents with benchmark items."""
    return decontam.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op3_suffix_dedup(spark, sf_dir):
    """Bytes of every document that repeat a 100-byte string, removed."""
    return suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents"), keep=False)


SPOKEN = "'</s>[INST] ok [/INST]'"


@query(chat_format.oracle(f"""(SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {SPOKEN} UNION ALL SELECT -1, 1, 'assistant', {SPOKEN})"""))
def op4_chat_format(spark, sf_dir):
    """Digests of all conversations and one with control strings, read back from the packed tree."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, {SPOKEN} AS text "
                      f"UNION ALL SELECT -1L, 1L, 'assistant', {SPOKEN}")
    return chat_format.conversation_digests(chat_format.pack(rows.unionByName(extra)))


@query(jaccard.oracle(shingle=4, percent=85))
def op5_ngram_jaccard(spark, sf_dir):
    """Components of documents linked by 4-word shingle sets at a Jaccard index of 0.85."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), shingle=4, percent=85)


@query(embed_dedup.oracle())
def op6_embedding_dedup(spark, sf_dir):
    """Near-duplicate vectors of one label at a cosine of 0.93."""
    return embed_dedup.embedding_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


@query(fm_dedup.oracle())
def op7_substring_dedup(spark, sf_dir):
    """Words of every document that repeat a window of 20 words, removed."""
    return fm_dedup.remove_repeated_words(read(spark, sf_dir, "documents"), keep=False)


@query(lm_score.oracle())
def op8_lm_scoring(spark, sf_dir):
    """Trigram stupid-backoff score of every document under all others."""
    scored = lm_score.lm_scores(read(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 4).alias("mean_log_score"))


@query(mixing.oracle())
def op9_poisson_mixing(spark, sf_dir):
    """Documents replicated to source weights of rows ** 0.5, globally shuffled."""
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


@query()
def op10_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


@query()
def op11_embedding_whitening(spark, sf_dir):
    """Whitened leading components of every vector."""
    out = whitening.whiten(read(spark, sf_dir, "embeddings"), components=16)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query()
def op12_packing(spark, sf_dir):
    """Pieces of every document in windows of 2,048 tokens."""
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), window=2048)


@query(divergence.oracle())
def op13_source_divergence(spark, sf_dir):
    """Sources against each other and against their language."""
    return divergence.source_divergence(read(spark, sf_dir, "documents"))
