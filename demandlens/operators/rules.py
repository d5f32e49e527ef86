"""Rules, lemmas and synonyms given as tables of any size.

The literal forms in ``text`` compile small rule sets into expressions.  Here the rules are
DataFrames that may grow with the data, so every step is an equi-join:

* keyword rules meet texts in a multi-pattern index: a keyword is filed under its rarest
  character trigram (its rarest among the texts; shorter keywords under themselves), texts look
  their distinct trigrams up, and ``contains`` verifies the few candidates;
* lemmas and synonyms are joined token by token, and the tokens are put together again in order.

Frequent trigrams and tokens cost little: rules avoid frequent trigrams, and tokens are looked up
as distinct words where possible; what skew remains is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.text import DEFAULT_DOMAIN, canonical
from demandlens.session import materialize

GRAM = 3
MAX_RULE_BYTES = 32 << 20   # keywords and domains that every task may hold
# fixed values: English suffix rules (suffix, what takes its place), longest first
SUFFIXES = [("sses", "ss"), ("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")]
MIN_STEM = 3


def rule_table(spark, rules: dict[str, list[str]]) -> DataFrame:
    """(domain, rank, keyword) of a literal rule set, ranked in declared order."""
    rows = [(d, i, k) for i, (d, ks) in enumerate(rules.items()) for k in ks]
    return spark.createDataFrame(rows, "domain string, rank long, keyword string")


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct character n-grams of a text (none when it is shorter)."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n)))
                  ).otherwise(F.array().cast("array<string>"))


def match_rules(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, domain, rank, keyword): of the rules whose keyword is inside the lower-case text, the one of
    least rank (ties: least domain, then keyword); ids without a match are left out.

    ``id_col`` identifies a text.  Null texts match nothing; empty and null keywords are no rules.
    """
    r = rules.select("domain", "rank", "keyword").where(F.length("keyword") > 0).distinct()
    t = texts.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_t")).where(F.col("_t").isNotNull())
    filed = r.withColumn("_g", F.explode(_grams(F.col("keyword"), F.least(F.length("keyword"), F.lit(GRAM)))))
    sizes = sorted(x[0] for x in r.select(F.least(F.length("keyword"), F.lit(GRAM))).distinct().collect())  # at most GRAM numbers
    if not sizes:
        return t.select(F.col("_id").alias(id_col), F.lit("").alias("domain"), F.lit(0).cast("long").alias("rank"), F.lit("").alias("keyword")).limit(0)
    held = t.select("_id", "_t", F.explode(F.concat(*[_grams(F.col("_t"), n) for n in sizes])).alias("_g"))
    # counted where the texts lie: what is shuffled is a row per distinct gram and task
    seen = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # the rarest of a keyword's grams; a gram that no text holds rules the keyword out
    rarest = (filed.join(seen, "_g", "left").groupBy("domain", "rank", "keyword")
              .agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_g"),
                   F.min(F.coalesce("_n", F.lit(0))).alias("_least"))
              .where("_least > 0").drop("_least"))
    rarest = materialize(rarest)
    if rarest.agg(F.coalesce(F.sum(F.octet_length("keyword") + F.octet_length(F.col("domain").cast("string")) + 64), F.lit(0))).first()[0] <= MAX_RULE_BYTES:
        # the rules go to the texts: neither texts nor candidates are shuffled
        hits = held.where(F.col("_id").isNotNull()).join(F.broadcast(rarest), "_g").where(F.contains("_t", "keyword"))
    else:
        hits = held.drop("_t").join(rarest, "_g").join(t, "_id").where(F.contains("_t", "keyword"))
    best = F.struct("rank", "domain", "keyword")
    return (hits.groupBy("_id").agg(F.min(best).alias("b"))
            .select(F.col("_id").alias(id_col), "b.domain", "b.rank", "b.keyword"))


def domains_by_rules(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str, default: str = DEFAULT_DOMAIN) -> DataFrame:
    """P4 with a rule table: (id, domain) of every text, ``default`` where no keyword matches."""
    hits = match_rules(texts, rules, id_col, text_col)
    return texts.select(id_col).join(hits.select(id_col, "domain"), id_col, "left").select(id_col, F.coalesce("domain", F.lit(default)).alias("domain"))


# --- lemmas and synonyms ------------------------------------------------------------

def mine_lemmas(words: DataFrame, suffixes: list[tuple[str, str]] | None = None, min_stem: int = MIN_STEM) -> DataFrame:
    """(word, lemma) from a table of words (``word``): a word whose suffix can be taken off so that the
    stem is itself a word of the table; the first suffix that fits wins.  One equi-join."""
    rules = suffixes or SUFFIXES
    w = words.select("word").where(F.col("word").isNotNull()).distinct()
    stems = F.array(*[F.when(F.endswith("word", F.lit(s)), F.struct(F.lit(i).alias("rule"), F.concat(
        F.expr(f"substring(word, 1, length(word) - {len(s)})"), F.lit(r)).alias("stem"))) for i, (s, r) in enumerate(rules)])
    tried = (w.select("word", F.explode(F.array_compact(stems)).alias("s")).select("word", "s.rule", "s.stem")
             .where(F.length("stem") >= min_stem))
    return (tried.join(w.withColumnRenamed("word", "stem"), "stem").groupBy("word")
            .agg(F.min_by("stem", "rule").alias("lemma")))


def _tokens(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    return df.select(id_col, F.posexplode(tokens).alias("_pos", "_tok"))


def _in_order(df: DataFrame, id_col: str, value: str, order: list[str], sep: str = " ") -> DataFrame:
    """(id, _joined): the values of an id joined in order; a group is one text."""
    parts = F.array_sort(F.collect_list(F.struct(*order, value)))
    return df.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x[value]), sep).alias("_joined"))


def lemmatise(texts: DataFrame, col: str, lemmas: DataFrame, out: str | None = None) -> DataFrame:
    """P6 with a lemma table (word, lemma; one lemma a word): the column lower-cased, trimmed, its tokens replaced by their
    lemmas and joined by one space.  Each distinct text is taken apart once; nulls stay null."""
    distinct = texts.select(F.col(col).alias("_text")).where(F.col(col).isNotNull()).distinct()
    toks = _tokens(distinct, "_text", F.filter(F.split(canonical("_text"), r"\s+"), lambda t: t != ""))
    found = toks.join(lemmas.select(F.col("word").alias("_tok"), "lemma"), "_tok", "left").withColumn("_tok", F.coalesce("lemma", "_tok"))
    whole = _in_order(found, "_text", "_tok", ["_pos"])
    blank = F.when(F.col(col).isNotNull(), F.coalesce("_joined", F.lit("")))
    joined = texts.join(whole, F.col(col) == F.col("_text"), "left")
    return joined.withColumn(out or col, blank).drop("_text", "_joined")


def expand_queries(queries: DataFrame, id_col: str, text_col: str, synonyms: DataFrame, lemmas: DataFrame, out: str = "expanded") -> DataFrame:
    """X3 with tables: ``synonyms`` (word, at, term) and ``lemmas`` (word, lemma).  Each token that is a
    synonym word, or else whose lemma is one, appends its terms in token order; the query is
    unchanged when nothing is added.  Lookups run over the distinct tokens."""
    toks = _tokens(queries, id_col, F.regexp_extract_all(F.lower(text_col), F.lit(r"\w+"), 0))
    words = toks.select("_tok").distinct()
    keys = synonyms.select(F.col("word").alias("_key")).distinct()
    own = words.join(keys, F.col("_tok") == F.col("_key"), "left")
    by_lemma = (lemmas.select(F.col("word").alias("_tok"), F.col("lemma").alias("_lemma"))
                .join(keys.select(F.col("_key").alias("_lemma")), "_lemma"))
    known = (own.join(by_lemma, "_tok", "left").select("_tok", F.coalesce("_key", "_lemma").alias("word"))
             .where(F.col("word").isNotNull()).join(synonyms, "word").select("_tok", "at", "term"))
    extra = _in_order(toks.join(known, "_tok"), id_col, "term", ["_pos", "at"])
    return (queries.join(extra, id_col, "left")
            .withColumn(out, F.when(F.col("_joined").isNotNull(), F.concat_ws(" ", F.col(text_col), "_joined")).otherwise(F.col(text_col)))
            .drop("_joined"))


def synonym_table(spark, synonyms: dict[str, list[str]]) -> DataFrame:
    """(word, at, term) of a literal synonym map."""
    return spark.createDataFrame([(k, j, v) for k, vs in synonyms.items() for j, v in enumerate(vs)], "word string, at int, term string")
