"""Text operators over item names and questions.

All of them are native expressions: regular-expression tokenising, array
higher-order functions, explode + group-by.  Rule tables are small fixed
constants compiled into ``CASE WHEN`` chains or map literals, so nothing is
joined against a growing table and nothing leaves the JVM.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: domain keyword table (declared order decides ties) --------
DOMAIN_KEYWORDS: dict[str, list[str]] = {
    "AI/ML": ["machine learning", "deep learning", "nlp", "neural", "llm",
              "transformer", "tensorflow", "pytorch", "mlops", "ai ", "genai",
              "generative", "reinforcement", "computer vision", "cv "],
    "Cloud": ["cloud", "aws", "azure", "gcp", "kubernetes", "docker",
              "serverless", "terraform", "multi-cloud", "microservice"],
    "Data": ["data", "sql", "spark", "hadoop", "analytics", "etl",
             "pipeline", "warehouse", "tableau", "powerbi", "statistics",
             "databricks"],
    "Security": ["security", "vulnerability", "encryption", "pentest",
                 "zero trust", "siem", "cryptography", "compliance", "soc"],
    "Web/Mobile": ["react", "angular", "vue", "node", "html", "css", "flutter",
                   "swift", "kotlin", "typescript", "javascript", "frontend"],
    "DevOps": ["devops", "ci/cd", "jenkins", "git", "agile", "scrum",
               "monitoring", "observability", "helm", "ansible", "devsecops"],
    "Systems/Infra": ["linux", "networking", "embedded", "iot", "fpga",
                      "microcontroller", "rtos", "hardware", "protocol", "5g",
                      "edge computing"],
    "Soft Skills": ["communication", "leadership", "problem solving", "teamwork",
                    "presentation", "agile mindset"],
}
DEFAULT_DOMAIN = "Other"

# --- fixed values: alias table applied to normalised coverage items ----------
ITEM_ALIASES: dict[str, str] = {
    "reactjs": "react", "react js": "react",
    "nodejs": "node.js", "node js": "node.js",
    "python basics": "python", "python basic": "python",
    "html/css": "html", "html / css": "html",
    "statistical analysis": "statistics", "statistic analysis": "statistics",
    "multi-cloud strategy": "multi-cloud", "multi cloud strategy": "multi-cloud",
    "devops practices": "devops", "devop practice": "devops",
    "search algorithms": "searching algorithms",
    "vulnerability assessment": "vulnerability scanning",
    "vulnerability assess": "vulnerability scanning",
    "query optimization": "sql optimization", "query optimise": "sql optimization",
    "neural networks": "deep learning", "neural network": "deep learning",
}

# --- fixed values: query synonyms and intent keywords (declared order) --------
QUERY_SYNONYMS: dict[str, list[str]] = {
    "ai": ["machine learning", "deep learning", "nlp", "llm", "generative ai"],
    "ml": ["machine learning", "deep learning", "mlops"],
    "cloud": ["aws", "azure", "gcp", "kubernetes", "serverless"],
    "security": ["vulnerability", "zero trust", "siem", "pentest"],
    "data": ["sql", "spark", "analytics", "etl", "databricks"],
    "devops": ["ci/cd", "jenkins", "helm", "ansible", "devsecops"],
    "web": ["react", "angular", "node.js", "html", "typescript"],
    "mobile": ["flutter", "swift", "kotlin", "react native"],
    "gap": ["not taught", "missing", "curriculum gap", "priority"],
    "urgent": ["highest priority", "debt score", "cli", "overdue"],
    "emerging": ["upcoming", "watch list", "early warning", "new skill"],
}
INTENT_FILTERS: list[tuple[str, str]] = [
    ("gap", "gap_summary"), ("missing", "gap_summary"),
    ("curriculum", "syllabus_card"), ("syllabus", "syllabus_card"),
    ("watch", "watch_list"), ("emerging", "watch_list"),
    ("upcoming", "trajectory_summary"), ("trajectory", "trajectory_summary"),
]

# A short English function-word list for keyword extraction (this library's
# own choice: the part-of-speech tagger of the original is not rebuilt).
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in",
              "into", "is", "it", "of", "on", "or", "the", "to", "with"]

TOKEN_PATTERN = r"\b\w\w+\b"   # two or more word characters


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: str | Column) -> Column:
    """lower(trim(x))."""
    return F.lower(F.trim(_col(c)))


def domain_of(c: str | Column, rules: dict[str, list[str]] | None = None,
              mode: str = "substring", default: str = DEFAULT_DOMAIN) -> Column:
    """First domain (declared order) with a keyword inside the text.

    ``mode='substring'`` keeps the original behaviour (``'soc'`` matches
    ``'social'``); ``mode='token'`` needs the keyword on word boundaries.
    """
    rules = rules or DOMAIN_KEYWORDS
    s = F.lower(_col(c))
    out = None
    for domain, kws in rules.items():
        if mode == "substring":
            cond = None
            for kw in kws:
                t = s.contains(kw)
                cond = t if cond is None else (cond | t)
        else:
            alts = "|".join(_re_escape(k.strip()) for k in kws)
            cond = s.rlike(rf"(^|\W)({alts})($|\W)")
        out = F.when(cond, F.lit(domain)) if out is None else out.when(cond, F.lit(domain))
    return out.otherwise(F.lit(default))


def _re_escape(s: str) -> str:
    import re

    return re.escape(s)


def _map_literal(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def apply_aliases(c: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """P5: alias lookup with identity default (a map literal: no join, no shuffle)."""
    m = _map_literal(aliases or ITEM_ALIASES)
    return F.coalesce(F.element_at(m, _col(c)), _col(c))


def lemma_normalise(c: str | Column, lemmas: dict[str, str] | None = None) -> Column:
    """P6 (re-aimed): lower/trim, split on white space, map each token through
    a lemma table (identity when absent), join by one space."""
    toks = F.split(canonical(c), r"\s+")
    if lemmas:
        m = _map_literal(lemmas)
        toks = F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), t))
    return F.array_join(F.filter(toks, lambda t: t != ""), " ")


def keywords(c: str | Column, stop_words: list[str] | None = None) -> Column:
    """P7 (re-aimed): non-stop-word tokens joined by ', '; the whole text if none."""
    stop = F.array(*[F.lit(w) for w in (stop_words or STOP_WORDS)])
    toks = F.filter(F.split(F.lower(F.trim(_col(c))), r"\s+"),
                    lambda t: (t != "") & ~F.array_contains(stop, t))
    return F.when(F.size(toks) > 0, F.array_join(toks, ", ")).otherwise(_col(c))


def top_tokens(df: DataFrame, group: str, kw_col: str, n: int = 4, out: str = "theme") -> DataFrame:
    """Per group, the n most frequent keywords (count desc, token asc) joined ' / '.

    Tokens are counted with a partial aggregation; the window is partitioned by
    group and cut to n rows per group before anything is collected, so each
    collected list holds at most n entries.
    """
    tok = (df.select(group, F.explode(F.split(kw_col, ", ")).alias("_tok"))
           .where(F.col("_tok") != ""))
    cnt = tok.groupBy(group, "_tok").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_n"), F.asc("_tok"))
    top = cnt.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_tok"))),
                                 lambda x: x["_tok"]), " / ").alias(out))


def tokens(c: str | Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), 0)


def _grams_of(toks: Column, n: int) -> Column:
    """The n-grams of a token array (empty when it is shorter than n).

    The lambda takes exactly one argument: ``transform`` would pass the
    element index as a second one.
    """
    def gram(i: Column) -> Column:
        return F.array_join(F.slice(toks, i, n), " ")

    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), gram)
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams(toks: Column, n_max: int = 2) -> Column:
    """All 1..n_max-grams of a token array (n-grams joined by one space)."""
    parts = [toks]
    for n in range(2, n_max + 1):
        parts.append(_grams_of(toks, n))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def tfidf_rarity(docs: DataFrame, id_col: str = "item", text_col: str = "item",
                 n_max: int = 2) -> DataFrame:
    """X1 + X2: rarity = mean of the L2-normalised TF-IDF row over the vocabulary.

    idf = ln((1 + N) / (1 + df)) + 1 (smooth), tf = raw count, terms are the
    1..n_max-grams of ``\\b\\w\\w+\\b`` tokens of the lower-cased text.
    rarity(d) = Σ_t w(d,t) / ‖w(d)‖ / V with V the vocabulary size.
    Three aggregations (term counts, document frequency, per-document sums);
    N and V are scalar subqueries.
    """
    tk = docs.select(F.col(id_col).alias("_id"), tokens(text_col).alias("_tk"))
    terms = tk.select("_id", F.explode(ngrams(F.col("_tk"), n_max)).alias("_t"))
    tf = terms.groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_tf"))
    dfreq = tf.groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    n_docs = docs.select(F.count_distinct(id_col)).scalar()
    vocab = dfreq.select(F.count(F.lit(1))).scalar()
    w = (tf.join(dfreq, "_t")
         .withColumn("_w", F.col("_tf") * (F.log((n_docs + 1) / (F.col("_df") + 1)) + 1)))
    per = w.groupBy("_id").agg(F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_w")).alias("_q"))
    rar = F.col("_s") / F.sqrt("_q") / vocab
    return (docs.select(F.col(id_col).alias("_id")).distinct()
            .join(per, "_id", "left")
            .select(F.col("_id").alias(id_col), F.coalesce(rar, F.lit(0.0)).alias("rarity")))


def expand_query(c: str | Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """X3 (re-aimed lemmas): tokens are lower-case words; a token whose form or
    whose form without a final 's' is a synonym key appends that key's terms,
    in token order.  The query is returned unchanged when nothing is added."""
    syn = synonyms or QUERY_SYNONYMS
    m = F.create_map(*chain.from_iterable(
        (F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in syn.items()))
    toks = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\w+"), 0)
    extra = F.flatten(F.transform(toks, lambda t: F.coalesce(
        F.element_at(m, t),
        F.when(t.endswith("s"), F.element_at(m, F.regexp_replace(t, "s$", ""))),
        F.array().cast("array<string>"))))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", _col(c), F.array_join(extra, " "))).otherwise(_col(c))


def intent_of(c: str | Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Card type of the first keyword (declared order) found in the query; null if none."""
    s = F.lower(_col(c))
    out = None
    for kw, t in (rules or INTENT_FILTERS):
        out = F.when(s.contains(kw), F.lit(t)) if out is None else out.when(s.contains(kw), F.lit(t))
    return out
