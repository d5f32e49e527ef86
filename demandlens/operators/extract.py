"""Coverage extraction from page text.

Pages are rows ``(doc_id, page_no, text)``.  Chunking, prompt building and
reply parsing are per-row or per-document expressions; the only grouping is
by (document, chunk), whose groups hold at most ``chunk_size`` pages.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.operators.order import global_index
from demandlens.operators.text import canonical

# fixed values: page filter, chunking, prompt and reply format
MIN_PAGE_CHARS = 100
CHUNK_SIZE = 3
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
FENCE_START, FENCE_END = r"^```[a-z]*\n?", r"```$"
PROMPT_MAX_CHARS = 4000
MAX_BROADCAST_TERMS = 500_000
PROMPT_TEMPLATE = (
    "Extract all course-skill pairs from this syllabus text.\n\n"
    "For reference, examples of relevant technical skills include:\n"
    "%s\n\n"
    "SYLLABUS TEXT:\n"
    "%s\n\n"
    "Output ONLY a JSON array like:\n"
    '[{"institute":"%s","semester":5,"course":"Computer Networks","skill":"networking"}]'
)
SAFE_IN_PATHS = " !$&()+,-.;<>@_`|~"   # characters Spark leaves as they are in partition folders
REPLY_KEYS = ("institute", "semester", "course", "skill")


def document_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   sep: str = "\n") -> DataFrame:
    """Split each document into pages (here: its lines), numbered from 0."""
    return documents.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(F.split(F.col(text_col), sep)).alias("page_no", "text"))


def kept_pages(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Trimmed page text, kept when longer than ``min_chars`` characters."""
    t = F.trim(F.col("text"))
    return pages.select("doc_id", "page_no", t.alias("text")).where(F.length("text") > min_chars)


def chunk_pages(pages: DataFrame, size: int = CHUNK_SIZE, sep: str = PAGE_BREAK) -> DataFrame:
    """M1: every ``size`` consecutive kept pages of a document joined by ``sep``.

    The page index is a row number inside each document (a window partitioned
    by document, never over the whole table); chunks do not cross documents.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    idx = pages.withColumn("_i", F.row_number().over(w) - 1)
    grp = idx.groupBy("doc_id", F.floor(F.col("_i") / size).cast("int").alias("chunk_no"))
    return grp.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.min("page_no").alias("first_page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))),
                                 lambda x: x["text"]), sep).alias("text"))


def global_chunk_pages(pages: DataFrame, size: int = CHUNK_SIZE, sep: str = PAGE_BREAK) -> DataFrame:
    """M1 over the flattened list of pages: every ``size`` consecutive kept pages of all documents, in the order
    of (doc_id, page_no), so that chunks cross documents.

    Pages are numbered by range partitions and their offsets (no window over the table); a chunk
    groups ``size`` rows: (chunk_no, n_pages, first_doc, last_doc, text).
    """
    idx = global_index(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"], "_i")
    return idx.groupBy(F.floor(F.col("_i") / size).cast("long").alias("chunk_no")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min_by("doc_id", "_i").alias("first_doc"), F.max_by("doc_id", "_i").alias("last_doc"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "text"))), lambda x: x["text"]), sep).alias("text"))


def prompt_parts(chunks: DataFrame, max_chars: int = PROMPT_MAX_CHARS) -> DataFrame:
    """Chunks cut into consecutive parts of at most ``max_chars`` characters, numbered from 0
    (an empty chunk has one empty part); the parts joined give the chunk."""
    last = F.greatest(F.ceil(F.length("text") / max_chars).cast("int") - 1, F.lit(0))
    parts = chunks.select("doc_id", "chunk_no", "text", F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    return parts.withColumn("text", F.substring(F.col("text"), F.col("part_no") * max_chars + 1, F.lit(max_chars)))


def prompt_batch(chunks: DataFrame, items: DataFrame, focal: str,
                 max_chars: int = PROMPT_MAX_CHARS) -> DataFrame:
    """One prompt per part of a chunk, with the dictionary items that the chunk mentions as
    reference (all of them, sorted; an empty list when there are none)."""
    hits = dictionary_mentions(chunks.select("doc_id", F.col("chunk_no").alias("page_no"), "text"), items)
    ref = (hits.groupBy("doc_id", F.col("page_no").alias("chunk_no"))
           .agg(F.array_join(F.array_sort(F.collect_set("item")), ", ").alias("_ref")))
    return prompt_parts(chunks, max_chars).join(ref, ["doc_id", "chunk_no"], "left").select(
        "doc_id", "chunk_no", "part_no",
        F.format_string(PROMPT_TEMPLATE, F.coalesce("_ref", F.lit("")), F.col("text"),
                        F.lit(focal.upper())).alias("prompt"))


TOKEN = r"[\w.+#/-]+"


def dictionary_mentions(pages: DataFrame, dictionary: DataFrame, col: str = "item", unique: bool = False) -> DataFrame:
    """M4: which dictionary entries occur in each page as whole token sequences: (doc_id, page_no, item), distinct.

    Entries of one token are joined to the page's distinct tokens.  Longer ones are joined by their
    first two tokens to the page's positions, which carry their next tokens beside them (shifted copies of the token
    array, no n-gram is ever put together), and the rest of the entry is compared there.  A
    dictionary of at most ``MAX_BROADCAST_TERMS`` entries (counted) is broadcast, so no page is
    shuffled; a larger one is joined by shuffle.  ``unique``: (doc_id, page_no) is known to be a key, which spares
    the shuffle of the hits that else removes repeats.
    """
    d = (dictionary.select(canonical(col).alias("_g")).where(F.col("_g").isNotNull())
         .withColumn("_g", F.array_join(F.split("_g", r"\s+"), " ")).distinct().withColumn("_w", F.split("_g", " ")))
    sizes = {r[0]: r[1] for r in d.groupBy(F.size("_w")).count().collect()}  # a row for each length
    small = sum(sizes.values()) <= MAX_BROADCAST_TERMS
    joined = lambda x: F.broadcast(x) if small else x
    longest = max(sizes, default=0)
    tk = pages.select("doc_id", "page_no", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0).alias("_t"))
    hits = tk.select("doc_id", "page_no", F.explode(F.array_distinct("_t")).alias("_g")).join(
        joined(d.where(F.size("_w") == 1).select("_g")), "_g").select("doc_id", "page_no", F.col("_g").alias("item"))
    if longest > 1:
        word = lambda k: F.col("_n")[str(k)]
        # a shifted copy is shorter, so the last positions have nulls there
        shifted = F.arrays_zip(*[F.slice("_t", k + 1, F.greatest(F.size("_t") - k, F.lit(0))).alias(str(k)) for k in range(longest)])
        at = tk.where(F.size("_t") > 1).select("doc_id", "page_no", F.explode(shifted).alias("_n")).where(word(1).isNotNull())
        at = at.select("doc_id", "page_no", *[word(k).alias(f"_t{k}") for k in range(longest)])
        long = d.where(F.size("_w") > 1).select("_g", *[F.get("_w", F.lit(k)).alias(f"_w{k}") for k in range(longest)])
        same = (F.col("_t0") == F.col("_w0")) & (F.col("_t1") == F.col("_w1"))
        found = at.join(joined(long), same)
        for k in range(2, longest):
            found = found.where(F.col(f"_w{k}").isNull() | (F.col(f"_w{k}") == F.col(f"_t{k}")))
        hits = hits.unionByName(found.select("doc_id", "page_no", F.col("_g").alias("item")).distinct())
    return hits if unique else hits.distinct()


REPLY_SCHEMA = "array<map<string,string>>"


def parse_replies(replies: DataFrame, focal: str, raw_col: str = "reply") -> DataFrame:
    """M2: reply text → coverage rows (chunk columns kept, one row per valid object).

    Code fences are stripped, the JSON array is parsed (a non-array or broken
    reply gives no rows), objects without all four keys are dropped, the
    provider is forced to ``focal``, the item is lower/trimmed, the course
    trimmed, the semester an int when all digits and in range, else 0.
    """
    raw = F.regexp_replace(F.trim(F.col(raw_col)), FENCE_START, "")
    raw = F.trim(F.regexp_replace(raw, FENCE_END, ""))
    keep = [c for c in replies.columns if c != raw_col]
    parsed = replies.select(*keep, F.from_json(raw, REPLY_SCHEMA).alias("_arr"))
    obj = parsed.select(*keep, F.explode("_arr").alias("_o"))
    has_all = None
    for k in REPLY_KEYS:
        t = F.map_contains_key("_o", k)
        has_all = t if has_all is None else has_all & t
    sem = F.col("_o")["semester"]
    return obj.where(has_all).select(
        *keep,
        F.lit(focal).alias("provider"),
        F.coalesce(F.when(sem.rlike(r"^[0-9]+$"), sem.try_cast("int")), F.lit(0)).alias("semester"),
        F.trim(F.col("_o")["course"]).alias("course"),
        F.lower(F.trim(F.col("_o")["skill"])).alias("item"))


def failed_chunks(replies: DataFrame, rows: DataFrame, keys=("doc_id", "chunk_no")) -> DataFrame:
    """M3: chunks whose reply gave no rows (dead letters), by anti-join."""
    return replies.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def split_chunks(chunks: DataFrame, sep: str = PAGE_BREAK) -> DataFrame:
    """M3: a failed chunk split back into its pages for a page-by-page retry."""
    return chunks.select("doc_id", "chunk_no",
                         F.posexplode(F.split("text", _regex_quote(sep))).alias("part_no", "text"))


def _regex_quote(s: str) -> str:
    import re

    return re.escape(s)


def dedup_rows(rows: DataFrame, min_len: int = 1, order: str | None = None) -> DataFrame:
    """M5 + D7: distinct (course, item) with item length > ``min_len``; first by ``order``."""
    return _first_by(rows.where(F.length("item") > min_len), ["course", "item"], order)


def _first_by(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Keep one row per key: the first by ``order`` (the other columns break ties).

    ``min_by`` over a struct is an ordinary aggregate, so a hot key is reduced
    map-side before the shuffle instead of landing whole in one window task.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    rank = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in others])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in others]).select(*df.columns)


def overlay(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """M6: union a correction table and de-duplicate again (full-row distinct)."""
    return rows.unionByName(manual.select(*rows.columns)).distinct()


def republish(catalogue: DataFrame, provider_rows: DataFrame, path: str, focal: str) -> None:
    """Replace one provider's rows, keep the others.

    The catalogue is stored partitioned by provider.  Replacement rows overwrite just the focal
    provider's folder; without any the folder is removed through Hadoop's file system.
    """
    rows = (provider_rows.where(F.col("provider") == focal)
            .select(*[c for c in catalogue.columns if c != "provider"], "provider"))
    if not rows.isEmpty():
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("provider").parquet(path))
        return
    sc = rows.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path, f"provider={quote(focal, safe=SAFE_IN_PATHS)}")
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
