"""Mixing sources to target weights by Poisson replication (DataFrame and SQL functions only).

Each source gets a mean repetition rate; each row's count is the Poisson quantile of a number
in [0, 1) taken from the md5 of (seed, id), so a re-run or a recomputed partition gives the
same copies.  Rows are exploded by their count and shuffled globally by a hash of
(seed, id, copy): a hash partition per key, then a sort inside the partition.

Rates: share(source) * budget / rows(source), where share is the given weight (or
rows ** alpha when no weights are given) over the sum of weights, and budget is the number
of rows unless given.  Sources without a given weight have weight 0.

Edge cases: a null source is a source of its own; a null id hashes as the word ``null``;
repeated rows get equal counts; texts are not read, so empty and long ones pass whole; input
columns named ``copy_no`` or ``shuffle_key`` are replaced, all others are kept whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.stage import unused

MAX_BROADCAST_SOURCES = 100_000
DIGITS = 13  # hex digits of the md5 that make the uniform number: 52 bits


def uniform(seed: int, *parts: Column) -> Column:
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16 ** DIGITS))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5,
                 budget: float | None = None, source_col: str = "source") -> DataFrame:
    """(source, n, rate, cdf): one row per source; cdf[k] is P(count <= k)."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = F.lit(0.0)
        for name, x in weights.items():
            given = F.when(F.col("source") == name, F.lit(float(x))).otherwise(given)
        w = n.withColumn("w", given)
    total = F.lit(float(budget)) if budget is not None else w.agg(F.sum("n").cast("double")).scalar()
    share = F.coalesce(F.try_divide(F.col("w"), w.agg(F.sum("w")).scalar()), F.lit(0.0))
    rates = w.select("source", "n", (share * total / F.col("n")).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    zero = F.struct(F.negate("rate").alias("logp"), F.exp(-F.col("rate")).alias("sum"),
                    F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def term(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.ln("rate") - F.ln(k.cast("double"))
        return F.struct(logp.alias("logp"), (acc["sum"] + F.exp(logp)).alias("sum"),
                        F.concat(acc["cdf"], F.array(acc["sum"] + F.exp(logp))).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), zero, term, lambda a: a["cdf"]))
    return rates.withColumn("cdf", F.coalesce(cdf, F.array(F.lit(1.0))))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5,
                budget: float | None = None, seed: int = 17, id_col: str = "doc_id",
                source_col: str = "source") -> DataFrame:
    """Rows of docs repeated to their Poisson counts, with ``copy_no`` (1..count) and
    ``shuffle_key``, in a global random order (partition by key hash, sorted by key inside)."""
    docs = docs.drop("copy_no", "shuffle_key")
    rates = source_rates(docs, weights, alpha, budget, source_col)
    name, cdf, times = unused(docs, "_mix_source", "_mix_cdf", "_mix_count")
    rates = rates.select(F.col("source").alias(name), F.col("cdf").alias(cdf))
    # The table of sources is broadcast only after its size is known; beyond that a
    # shuffled join is used, whose hot sources adaptive execution splits.
    if docs.select(source_col).distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    u = uniform(seed, F.col(id_col))
    counted = (docs.join(rates, F.col(source_col).eqNullSafe(F.col(name)))
               .withColumn(times, F.size(F.filter(cdf, lambda c: c <= u)))
               .drop(name, cdf).filter(F.col(times) > 0))
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times)
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "copy_no"))
    return copies.withColumn("shuffle_key", key).repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def oracle(docs: str = "documents", alpha: float = 0.5, seed: int = 17) -> str:
    """DuckDB SQL for mix_sources() with default weights."""
    return f"""
WITH w AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {alpha}) AS w FROM {docs} GROUP BY source),
r AS (SELECT source, (w / (SELECT sum(w) FROM w)) * (SELECT sum(n) FROM w) / n AS rate FROM w),
k AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT))) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT d.*, ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, {DIGITS}))::BIGINT / {float(16 ** DIGITS)!r} AS _u FROM {docs} d),
e AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u._u) AS _n FROM u),
x AS (SELECT e.*, unnest(generate_series(1, _n)) AS copy_no FROM e)
SELECT d.* EXCLUDE (_u, _n, copy_no), CAST(d.copy_no AS INTEGER) AS copy_no, md5('order{seed}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.copy_no) AS shuffle_key FROM x d"""
