"""Source divergence audit by count-cell ranking.

Every (language, source) group is set against its language (part ``term``: the terms that the
group uses more) and against the language's other sources (part ``pair``).  Terms are runs of
ASCII letters and non-ASCII characters, A-Z lowered; a language keeps those that at least
``min_docs`` of its rows hold.  With count c, the sum N of a group's counts over kept terms and
V kept terms, a term's smoothed share is ``p = 1 + floor(SCALE * (c + 2) / (N + 2 V))`` and the
divergence of two shares is ``f = floor((p - q)^2 / (p + q))``, all in whole numbers.

Count cells: terms of a group with the same count there and the same count in the language have
the same p, q and f.  So terms are grouped by (group count, language count), f is evaluated once
a cell, cells of equal value are merged, and ranked by cumulative multiplicity until the wanted
ranks are filled; only the terms of those cells are read back, in UTF-8 order.

Pairs of sources: the output holds each pair of a language's sources by contract.  Each kept
term is one row with the shares of the sources that use it; a task lays a bounded number of
such rows out as a block (terms x sources, unused ones at the share of count 0) and returns one
sum for each pair, so no pair of rows is ever emitted.

How it runs: terms are counted inside the scan's tasks, by occurrence and by document, so that a hot
term or source costs one row per task, and no document is shuffled; a task holds a bounded number
of terms at a time.  Sums stay below 2^63 for up to 9e15 counted terms.

Edge cases: null text, lang and source read as ''; empty texts add a group without terms; rows
are documents, so repeated rows and null ids count each; a language without kept terms has V = 0,
pairs of value 0 and no terms; a source alone in its language has no pairs; very long texts are
read in slices that cut no term; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.stage import staged

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES, NO_TERM = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
SLICE, HELD = 1 << 20, 1 << 18
SCALE_STEPS = 3  # SCALE = 1000 ** 3
SCALE = 1000 ** SCALE_STEPS
MIN_DOCS = 10
TOP = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_CELLS = 1 << 18  # counts that a task holds in one block
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 16 << 20


def read_documents(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))


def slices(text: bytes):
    """Pieces of about SLICE bytes, cut where no term is cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cut = NO_TERM.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def count_terms(batches):
    """(lang, source, text) -> (lang, source, term, n, d), counted in the task until it holds
    HELD terms; UTF-8 bytes above 0x7F are those of non-ASCII characters."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, d) in held.items():
            if n:
                same = lambda x: pa.array([x]).take(pa.array(np.zeros(len(n), np.int8)))
                yield pa.RecordBatch.from_arrays(
                    [same(lang), same(source), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "d"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            terms: set[bytes] = set()
            for piece in slices(text.as_buffer().to_pybytes().lower()):
                found = TERM_BYTES.findall(piece)
                n.update(found)
                terms.update(found)
            d.update(terms)
        if sum(len(n) for n, _ in held.values()) >= HELD:
            yield from flush()
    yield from flush()


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, d rows that hold it)."""
    counted = rows.select("lang", "source", "text").mapInArrow(count_terms, "lang string, source string, term string, n bigint, d bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)) by long division in base 1000."""
    d = total + 2 * kept
    state = F.struct(F.lit(0).cast("long").alias("q"), (count + 2).alias("r"))
    step = lambda a, _: F.struct((a["q"] * 1000 + F.call_function("div", a["r"] * 1000, d)).alias("q"),
                                 (a["r"] * 1000 % d).alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(SCALE_STEPS)]), state, step, lambda a: a["q"] + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(batches):
    """Rows (lang, kept: V, totals: N of each source, at, n: sources that use the term and their
    counts) -> (lang, a, b, value): one sum for each pair of sources and block."""

    def shares(count, total, kept):
        rest, out, d = count + 2, np.zeros_like(count), total + 2 * kept
        for _ in range(SCALE_STEPS):
            rest = rest * 1000
            out = out * 1000 + rest // d
            rest %= d
        return out + 1

    def flush(lang, kept, totals, block):
        counts = np.zeros((len(totals), len(block)), np.int64)
        for k, (at, n) in enumerate(block):
            counts[at, k] = n
        p = shares(counts, totals[:, None], kept)
        a, b, value = [], [], []
        for k in range(len(totals) - 1):
            q = p[k + 1:]
            gap = q - p[k]
            value.append((gap * gap // (q + p[k])).sum(axis=1))
            a.append(np.full(len(q), k, np.int32))
            b.append(np.arange(k + 1, len(totals), dtype=np.int32))
        value = np.concatenate(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(np.concatenate(a)),
                                           pa.array(np.concatenate(b)), pa.array(value)], ["lang", "a", "b", "value"])

    blocks: dict[str, tuple[int, np.ndarray, list]] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for r, lang in enumerate(names):
            if lang not in blocks:
                blocks[lang] = (batch.column(1)[r].as_py(), batch.column(2)[r].values.to_numpy().copy(), [])
            kept, totals, block = blocks[lang]
            if len(totals) < 2:
                continue
            block.append((batch.column(3)[r].values.to_numpy().copy(), batch.column(4)[r].values.to_numpy().copy()))
            if len(block) * len(totals) >= BLOCK_CELLS:
                yield flush(lang, kept, totals, block)
                block.clear()
    for lang, (kept, totals, block) in blocks.items():
        if block:
            yield flush(lang, kept, totals, block)


def small(df: DataFrame, *texts: str) -> DataFrame:
    """df (written before), marked for broadcast if its rows and the bytes of its text columns stay within
    the bounds; beyond them the join is shuffled."""
    size = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.octet_length(c)).alias(c) for c in texts)).first()
    return F.broadcast(df) if size["n"] <= MAX_BROADCAST_ROWS and sum(size[c] or 0 for c in texts) <= MAX_BROADCAST_BYTES else df


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text",
                      lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source) group."""
    rows = read_documents(docs, text_col, lang_col, source_col)
    names = staged(rows.select("lang", "source").distinct()
                   .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "sources")
    by_name = small(names, "lang", "source")
    kept = staged(term_counts(rows).join(by_name, ["lang", "source"]).groupBy("lang", "term")
                  .agg(F.sum("n").alias("all"), F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("uses"))
                  .filter(F.col("d") >= min_docs).drop("d"), "terms")
    used = kept.select("lang", "term", "all", F.explode("uses").alias("u")).select("lang", "term", "all", "u.at", "u.n")
    zero = F.lit(0).cast("long")
    langs = kept.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    totals = used.groupBy("lang", "at").agg(F.sum("n").alias("total"))
    groups = staged(names.join(totals, ["lang", "at"], "left").join(langs, "lang", "left")
                    .select("lang", "source", "at", *(F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept"))), "groups")
    by_place = small(groups, "lang", "source")

    # part term: cells, merged by value, ranked by cumulative multiplicity
    cells = (used.groupBy("lang", "at", "n", "all").agg(F.count(F.lit(1)).alias("m"))
             .join(by_place.drop("source"), ["lang", "at"])
             .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
             .withColumn("q", share(F.col("all"), F.col("lang_total"), F.col("kept")))
             .filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q"))))
    cells = staged(cells.select("lang", "at", "n", "all", "m", "value"), "cells")
    by_value = Window.partitionBy("lang", "at").orderBy(F.desc("value"))
    merged = (cells.groupBy("lang", "at", "value").agg(F.sum("m").alias("m"))
              .withColumn("k", F.row_number().over(by_value)).filter(F.col("k") <= top)
              .withColumn("before", F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
              .filter(F.col("before") < top))
    chosen = cells.join(merged.select("lang", "at", "value", "before"), ["lang", "at", "value"]).drop("m")
    in_value = Window.partitionBy("lang", "at", "value", "before").orderBy("term")
    terms = (used.join(chosen, ["lang", "at", "n", "all"])
             .withColumn("k", F.row_number().over(in_value)).filter(F.col("k") <= top)
             .withColumn("rank", (F.col("before") + F.col("k")).cast("int")).filter(F.col("rank") <= top)
             .select("lang", "at", F.col("term").alias("item"), "value", "rank")
             .join(by_place.select("lang", "at", "source"), ["lang", "at"])
             .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

    # part pair: sums over blocks of terms; a language's sources without any kept term have value 0
    listed = (groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "total"))).alias("s"), F.max("kept").alias("kept"))
              .select("lang", "kept", F.transform("s", lambda x: x["total"]).alias("totals")))
    if by_place is not groups:
        listed = F.broadcast(listed)
    sums = (kept.join(listed, "lang")
            .select("lang", "kept", "totals", F.transform("uses", lambda u: u["at"]).alias("at"), F.transform("uses", lambda u: u["n"]).alias("n"))
            .mapInArrow(pair_sums, "lang string, a int, b int, value bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("other")),
                                                 F.struct(F.col("b").alias("at"), F.col("a").alias("other")))).alias("e"), "value")
    found = (both.select("lang", "e.at", "e.other", "value")
             .join(by_place.select("lang", "at", "source"), ["lang", "at"])
             .join(by_place.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), ["lang", "other"])
             .select("lang", "source", "item", "value"))
    bare = groups.filter("kept = 0").select("lang", "source")
    still = (bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
             .select("lang", "source", "item", zero.alias("value")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.unionAll(still).select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                                         F.row_number().over(ranked).alias("rank"))
    return pairs.unionAll(terms)


def oracle(docs: str = "documents", min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """DuckDB SQL for source_divergence()."""
    f = "((p - q) * (p - q)) // (p + q)"
    return f"""
WITH r AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM {docs}),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM r),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= {min_docs}),
g AS (SELECT DISTINCT lang, source FROM r),
c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS lc,
        1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p,
        1 + ({SCALE}::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
w AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
x AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM w
  UNION ALL
  SELECT lang, source, 'term', term, {f}, row_number() OVER (PARTITION BY lang, source ORDER BY {f} DESC, term) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM x WHERE part = 'pair' OR rank <= {top}"""
