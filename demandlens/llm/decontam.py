"""Benchmark decontamination by spaced seeds (DataFrame and SQL functions only).

Tokens are runs of letters and digits, lower-cased.  A mask keeps some positions of a span
of tokens and ignores the others, so a seed still matches when an ignored token was
substituted.  The two masks below find every window of 12 tokens with at most 2
substitutions (checked over all placements in the tests).  Seeds of all document positions
are joined to the seeds of the test items; a hit fixes the diagonal (document position minus
item position), and the aligned tokens around it are compared: an overlap is reported when
some window of 12 aligned tokens has at most 2 mismatches.  Items with fewer tokens than
a window count when they occur whole.

The seeds of the items are broadcast only after their number (``max_broadcast_seeds``) and the
tokens that travel with them (``MAX_BROADCAST_TOKENS``) are checked; a larger test set is joined
by shuffle on the seed, its hits become distinct diagonals first, and the documents'
tokens are fetched for these by a second join.  Both ways give the same rows.

Edge cases: null or empty texts and texts without letters or digits have no tokens and no
rows; very long texts are covered whole; repeated rows (same id, same text) count as one;
rows with one id and different texts are all searched and reported under that id; null
document ids are reported as null; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.stage import unused

WINDOW = 12
MISMATCHES = 2
MASKS = ("111011", "11010011")
MAX_BROADCAST_SEEDS = 2_000_000
MAX_BROADCAST_TOKENS = 8_000_000   # of 8 bytes each, over all seeds of all items
NOT_TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN, " "), " "), lambda w: w != "")


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(h: Column, at: Column, masks: list[str]) -> Column:
    """Array of the seeds of every mask at position ``at`` (0-based); null where a mask
    reaches past the end."""
    def seed(i: int, mask: str) -> Column:
        kept = [F.get(h, at + F.lit(j)) for j, c in enumerate(mask) if c == "1"]
        return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(i), F.lit(len(mask)), *kept))
    return F.array(*(seed(i, m) for i, m in enumerate(masks)))


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  max_broadcast_seeds: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, diagonal, n_aligned, n_matched): one row per document, item and
    diagonal with a verified overlap."""
    bench = (items.select(F.col(item_col).alias("item_id"), hashes(F.col(item_text_col)).alias("t"))
             .filter(F.size("t") > 0).distinct())
    short = [r[0] for r in bench.filter(F.size("t") < WINDOW).select(F.size("t")).distinct().collect()]  # at most 11 values
    masks = [*MASKS, *("1" * n for n in sorted(short))]
    # A mask as long as a short item is for items of just that length.
    fits = F.when(F.size("t") < WINDOW, F.array(*(F.lit(i >= len(MASKS)) & (F.size("t") == len(m)) for i, m in enumerate(masks)))
                  ).otherwise(F.array(*(F.lit(i < len(MASKS)) for i in range(len(masks)))))
    bench_seeds = (bench.withColumn("fits", fits)
                   .select("*", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("q"))
                   .select("item_id", "t", "q", "fits", F.posexplode(seeds(F.col("t"), F.col("q"), masks)).alias("m", "seed"))
                   .filter(F.get("fits", F.col("m")) & F.col("seed").isNotNull())
                   .select("item_id", "t", "q", "seed"))
    rows = docs.select(F.col(id_col).alias("doc_id"), hashes(F.col(text_col)).alias("h"))
    at = rows.filter(F.size("h") > 0).select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("p"))
    seeded = at.select("doc_id", "h", "p", F.explode(seeds(F.col("h"), F.col("p"), masks)).alias("seed"))
    diagonal = (F.col("p") - F.col("q")).alias("diagonal")
    # a seed travels with its whole item, so the bound is on their tokens as well
    size = bench_seeds.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("tokens")).first()
    if size["n"] <= max_broadcast_seeds and size["tokens"] <= MAX_BROADCAST_TOKENS:
        hits = (seeded.join(F.broadcast(bench_seeds), "seed")
                .select("doc_id", "item_id", "t", diagonal, aligned("h", F.col("p") - F.col("q"), "t")))
    else:
        keyed = seeded.select("doc_id", "p", "seed").filter("seed is not null")
        found = (keyed.join(bench_seeds.select("item_id", "q", "seed"), "seed")
                 .select("doc_id", "item_id", diagonal).distinct())
        hits = (found.join(bench, "item_id").join(rows, found.doc_id.eqNullSafe(rows.doc_id))
                .select(found.doc_id, "item_id", "t", "diagonal", aligned("h", F.col("diagonal"), "t")))
    same = F.transform(F.sequence(F.lit(0), F.size("t") - 1),
                       lambda i: F.coalesce(F.get("own", i + F.least("diagonal", F.lit(0))) == F.get("t", i), F.lit(False)))
    width = F.least(F.size("t"), F.lit(WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("t") - width + 1),
                                   lambda i: F.size(F.filter(F.slice("same", i, width), lambda x: x))))
    need = F.when(F.size("t") < WINDOW, F.size("t")).otherwise(WINDOW - MISMATCHES)
    return (hits.groupBy("doc_id", "item_id", "diagonal", F.xxhash64("own").alias("_own"))
            .agg(F.first("t").alias("t"), F.first("own").alias("own"))
            .withColumn("same", same).filter(best >= need)
            .groupBy("doc_id", "item_id", "diagonal")
            .agg(F.max(F.size("own")).cast("int").alias("n_aligned"),
                 F.max(F.size(F.filter("same", lambda x: x))).cast("int").alias("n_matched")))


def aligned(h: str, diagonal: Column, t: str) -> Column:
    """Document tokens that stand against the item on this diagonal."""
    return F.slice(h, F.greatest(diagonal, F.lit(0)) + 1, F.size(t) + F.least(diagonal, F.lit(0))).alias("own")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        **kw) -> DataFrame:
    """Rows of docs without a verified overlap with any item."""
    (name,) = unused(docs, "_bad")
    bad = find_overlaps(docs, items, id_col, text_col, **kw).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def token_sql(text: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), "
            f"'[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')")


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for find_overlaps() against the table ``benchmark``."""
    def key(i: int, mask: str, alias: str) -> str:
        parts = ", ".join(f"t[{alias} + {j + 1}]" for j, c in enumerate(mask) if c == "1")
        return f"CASE WHEN {alias} + {len(mask)} <= len(t) THEN concat_ws(' ', '{i}', {parts}) END"
    seeds_ = ", ".join(key(i, m, "p") for i, m in enumerate(MASKS))
    return f"""
WITH d AS (SELECT doc_id, {token_sql('text')} AS t FROM {docs}),
b AS (SELECT item_id, {token_sql('text')} AS t FROM benchmark),
dp AS (SELECT doc_id, t, unnest(range(len(t))) AS p FROM d),
bp AS (SELECT item_id, t, unnest(range(len(t))) AS p FROM b),
ds AS (SELECT doc_id, p, unnest([{seeds_}]) AS s FROM dp),
bs AS (SELECT item_id, p, unnest([{seeds_}]) AS s FROM bp WHERE len(t) >= {WINDOW}),
short AS (SELECT dp.doc_id, b.item_id, dp.p AS diagonal FROM dp JOIN b ON len(b.t) < {WINDOW} AND len(b.t) > 0 AND dp.t[dp.p + 1] = b.t[1] AND list_slice(dp.t, dp.p + 1, dp.p + len(b.t)) = b.t),
c AS (SELECT doc_id, item_id, ds.p - bs.p AS diagonal FROM ds JOIN bs USING (s) UNION SELECT * FROM short),
a AS (SELECT c.*, d.t AS dt, b.t AS bt FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
m AS (SELECT doc_id, item_id, diagonal, q, len(bt) AS n, (q + diagonal >= 0 AND q + diagonal < len(dt))::INT AS inside,
        coalesce((CASE WHEN q + diagonal >= 0 THEN dt[q + diagonal + 1] END) = bt[q + 1], false)::INT AS same
      FROM (SELECT *, unnest(range(len(bt))) AS q FROM a)),
w AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS got FROM m)
SELECT doc_id, item_id, diagonal::INTEGER AS diagonal, sum(inside)::INTEGER AS n_aligned, sum(same)::INTEGER AS n_matched
FROM w GROUP BY doc_id, item_id, diagonal, n HAVING max(got) >= CASE WHEN n < {WINDOW} THEN n ELSE {WINDOW - MISMATCHES} END"""
