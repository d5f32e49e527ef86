"""Text cards for retrieval (C1-C5, C7) built from the scored item table.

Every card is one row ``(id, type, text, priority_score)``; card texts are
``concat`` / ``format_string`` expressions, lists inside a card come from
group-limited windows or ordered ``collect_list`` of bounded groups.

Numbers in texts are formatted through DECIMAL rounding (half-up), so every
engine prints the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.operators.collection import metadata

# fixed values: card vocabulary
CARD_TYPES = ("skill_card", "trajectory_summary", "watch_list", "syllabus_card", "gap_summary")
TRAJECTORY_DESCRIPTIONS = {
    "Traditional": "Established skills, may have declining industry relevance.",
    "Transitional": "Stable skills shifting in how they are applied.",
    "Upcoming": "Emerging rapidly — highest urgency for curriculum addition.",
}
TOP_GAPS_PER_TRAJECTORY = 5
TOP_GAPS_IN_SUMMARY = 10


def fmt(c, digits: int) -> Column:
    """A number as text with ``digits`` decimals (DECIMAL half-up rounding)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")


def _ordered_join(struct_col: Column, field: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(struct_col), lambda x: x[field]), sep)


def card_id(prefix: str, name: Column) -> Column:
    """``prefix_`` + name with spaces and slashes replaced by '_' (C1/C4 ids)."""
    return F.concat(F.lit(prefix + "_"), F.translate(name, " /", "__"))


def item_cards(items: DataFrame, focal: str, n_companies: Column, n_providers: Column,
               trajectory_names: dict[str, str] | None = None) -> DataFrame:
    """One card per item.

    ``items`` is the scored table with graph columns (``top_cooccurring``,
    ``propagated_gap``).  Optional clauses (watch, transition, co-occurrence,
    propagation) are null-skipping parts of ``concat_ws``.
    """
    name = _traj_name(trajectory_names)
    taught = F.when(F.col("is_covered") == 1, F.lit(f"currently taught at {focal.upper()}")) \
        .otherwise(F.lit(f"NOT taught at {focal.upper()} — curriculum gap"))
    # fixed values: the sentences of an item card, in their order
    base = F.concat(
        F.lit("Skill: "), F.col("item"), F.lit(". Trajectory: "), name, F.lit(". Status: "), taught,
        F.lit(". Demanded by "), F.col("company_spread").cast("string"), F.lit(" of "),
        n_companies.cast("string"), F.lit(" companies, total frequency "), F.col("freq").cast("string"),
        F.lit(". Trend slope: "), fmt("trend_slope", 2), F.lit(". Velocity: "), fmt("velocity", 2),
        F.lit(". Curriculum Lag Index: "), F.col("lag").cast("string"), F.lit(" years. Priority Score: "),
        fmt("priority_score", 3), F.lit(". Debt Score: "), fmt("debt_score", 3), F.lit("."))
    missing = F.concat(F.lit(" Missing from "), (n_providers - F.col("taught_count")).cast("string"),
                       F.lit("/"), n_providers.cast("string"), F.lit(" institutes."))
    watch = F.when(F.col("watch_list") == 1, F.lit(" On the Early Warning Watch List."))
    trans = F.when(F.col("in_transition") == 1,
                   F.concat(F.lit(" Transitioning: "), F.col("transition"), F.lit(".")))
    cooc = F.when(F.coalesce(F.col("top_cooccurring"), F.lit("")) != "",
                  F.concat(F.lit(" Co-occurs with: "), F.col("top_cooccurring"), F.lit(".")))
    prop = F.when(F.col("propagated_gap") > 0,
                  F.concat(F.lit(" Propagated gap score: "), fmt("propagated_gap", 3), F.lit(".")))
    text = F.concat_ws("", base, missing, watch, trans, cooc, prop)
    return items.select(card_id("skill", F.col("item")).alias("id"), F.lit("skill_card").alias("type"),
                        text.alias("text"), F.col("priority_score"), F.col("item"),
                        (1 - F.col("is_covered")).alias("is_gap"),
                        metadata(trajectory=name, is_gap=1 - F.col("is_covered"), lag=F.col("lag"),
                                 watch_list=F.col("watch_list"), debt_score=F.col("debt_score")).alias("meta"))


def _traj_name(names: dict[str, str] | None) -> Column:
    if not names:
        return F.col("trajectory")
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(m, F.col("trajectory")), F.col("trajectory"))


def trajectory_cards(items: DataFrame, focal: str,
                     trajectory_names: dict[str, str] | None = None) -> DataFrame:
    """One card per trajectory group: sizes, mean lag and priority, top 5 gaps by priority."""
    named = items.withColumn("_name", _traj_name(trajectory_names))
    stats = named.groupBy("_name").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("is_covered") == 0).alias("_g"),
        F.avg("lag").alias("_lag"), F.avg("priority_score").alias("_prio"))
    w = Window.partitionBy("_name").orderBy(F.desc("priority_score"), F.asc("item"))
    top = (named.where(F.col("is_covered") == 0).withColumn("_r", F.row_number().over(w))
           .where(F.col("_r") <= TOP_GAPS_PER_TRAJECTORY)
           .groupBy("_name").agg(_ordered_join(F.collect_list(F.struct("_r", "item")), "item", ", ")
                                 .alias("_top")))
    desc = F.create_map(*[F.lit(x) for kv in TRAJECTORY_DESCRIPTIONS.items() for x in kv])
    j = stats.join(top, "_name", "left")
    # fixed values: the sentences of a trajectory card
    text = F.concat(
        F.lit("Trajectory group: "), F.col("_name"), F.lit(". "),
        F.coalesce(F.element_at(desc, F.col("_name")), F.lit("")), F.lit(" "),
        F.col("_n").cast("string"), F.lit(" total skills, "), F.col("_g").cast("string"),
        F.lit(f" not taught at {focal.upper()}. Average CLI: "), fmt("_lag", 1),
        F.lit(" years. Average Priority Score: "), fmt("_prio", 3),
        F.lit(". Top gap skills by priority: "), F.coalesce(F.col("_top"), F.lit("")), F.lit("."))
    return j.select(F.concat(F.lit("trajectory_"), F.lower("_name")).alias("id"),
                    F.lit("trajectory_summary").alias("type"), text.alias("text"),
                    F.lit(None).cast("double").alias("priority_score"))


def watch_card(items: DataFrame, focal: str, trajectory_names: dict[str, str] | None = None) -> DataFrame:
    """One card listing watched gap items by urgency (desc, item asc); no card if none."""
    w = items.where((F.col("watch_list") == 1) & (F.col("is_covered") == 0))
    entry = F.concat(F.col("item"), F.lit(" (urgency "), fmt("watch_urgency", 3), F.lit(", "),
                     F.col("company_spread").cast("string"), F.lit(" companies, "),
                     _traj_name(trajectory_names), F.lit(")"))
    agg = w.agg(F.count(F.lit(1)).alias("_n"),
                F.array_join(F.transform(F.array_sort(F.collect_list(
                    F.struct((-F.col("watch_urgency")).alias("u"), F.col("item").alias("i"),
                             entry.alias("e")))), lambda x: x["e"]), " | ").alias("_e"))
    # fixed values: the sentences of the watch-list card
    text = F.concat(
        F.lit(f"Early Warning Watch List for {focal.upper()} — "), F.col("_n").cast("string"),
        F.lit(" emerging skills not yet mainstream but rising fast. Faculty should plan additions now. "
              "Skills ranked by urgency: "), F.col("_e"), F.lit("."))
    return agg.where(F.col("_n") > 0).select(
        F.lit(f"watch_list_{focal}").alias("id"), F.lit("watch_list").alias("type"), text.alias("text"),
        F.lit(None).cast("double").alias("priority_score"))


def coverage_cards(coverage: DataFrame) -> DataFrame:
    """C4: one card per (provider, course): items (sorted), semester of the first, count."""
    g = coverage.groupBy("provider", "course").agg(
        F.array_sort(F.collect_list(F.struct("item", "semester"))).alias("_l"),
        F.count(F.lit(1)).alias("_n"))
    # fixed values: the sentences of a coverage card
    text = F.concat(
        F.lit("Institute: "), F.upper("provider"), F.lit(". Course: "), F.col("course"),
        F.lit(" (Semester "), F.col("_l")[0]["semester"].cast("string"), F.lit("). Skills taught: "),
        F.array_join(F.transform("_l", lambda x: x["item"]), ", "), F.lit(". Total: "),
        F.col("_n").cast("string"), F.lit(" skills."))
    return g.select(F.concat(F.lit("syllabus_"), F.col("provider"), F.lit("_"),
                             F.translate("course", " ", "_")).alias("id"),
                    F.lit("syllabus_card").alias("type"), text.alias("text"),
                    F.lit(None).cast("double").alias("priority_score"))


def gap_summary_card(items: DataFrame, focal: str, n_companies: Column, year_lo: Column,
                     year_hi: Column) -> DataFrame:
    """One card: gap count, top 10 by priority and by debt, items in transition,
    mean lag and total debt over the gap items."""
    gaps = items.where(F.col("is_covered") == 0)

    def top(col: str) -> DataFrame:
        # a top-10 (TakeOrdered), then one ordered list of those ten rows
        t = gaps.orderBy(F.desc(col), F.asc("item")).limit(TOP_GAPS_IN_SUMMARY)
        return t.agg(_ordered_join(F.collect_list(F.struct((-F.col(col)).alias("k"), "item")),
                                   "item", ", ").alias("v"))

    trans = gaps.where(F.col("in_transition") == 1).agg(
        F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("v"))
    s = gaps.agg(F.count(F.lit(1)).alias("_g"), F.avg("lag").alias("_lag"),
                 F.sum("debt_score").alias("_debt"))
    n_all = items.select(F.count(F.lit(1))).scalar()
    tp, td, tr = top("priority_score").scalar(), top("debt_score").scalar(), trans.scalar()
    # fixed values: the sentences of the gap summary
    text = F.concat(
        F.lit(f"{focal.upper()} curriculum gap summary. "), F.col("_g").cast("string"), F.lit(" of "),
        n_all.cast("string"), F.lit(f" industry skills are not taught at {focal.upper()}. Data from "),
        n_companies.cast("string"), F.lit(" companies, "), year_lo.cast("string"), F.lit("-"),
        year_hi.cast("string"), F.lit(". Top 10 by Priority Score: "), F.coalesce(tp, F.lit("")),
        F.lit(". Top 10 by Debt Score: "), F.coalesce(td, F.lit("")),
        F.lit(". Skills in transition: "),
        F.when(F.coalesce(tr, F.lit("")) == "", F.lit("none")).otherwise(tr),
        F.lit(". Average CLI: "), fmt("_lag", 1), F.lit(" years. Total curriculum debt: "),
        fmt("_debt", 2), F.lit("."))
    return s.select(F.lit(f"gap_summary_{focal}").alias("id"), F.lit("gap_summary").alias("type"),
                    text.alias("text"), F.lit(None).cast("double").alias("priority_score"))


def all_cards(item: DataFrame, traj: DataFrame, watch: DataFrame, syllabus: DataFrame,
              gap: DataFrame, with_meta: bool = False) -> DataFrame:
    """All cards as (id, type, text, priority_score); ``with_meta`` adds the metadata map, which only item cards fill."""
    cols = ["id", "type", "text", "priority_score"]
    if with_meta:
        empty = F.create_map().cast("map<string,string>").alias("meta")
        rest = traj.select(*cols).unionByName(watch.select(*cols)).unionByName(syllabus.select(*cols)).unionByName(gap.select(*cols))
        return item.select(*cols, "meta").unionByName(rest.select(*cols, empty))
    return (item.select(*cols).unionByName(traj.select(*cols)).unionByName(watch.select(*cols))
            .unionByName(syllabus.select(*cols)).unionByName(gap.select(*cols)))


def card_inventory(cards: DataFrame) -> DataFrame:
    """Number of cards per type."""
    return cards.groupBy("type").agg(F.count(F.lit(1)).alias("n_cards"))


def duplicate_ids(cards: DataFrame) -> DataFrame:
    """S5 check: ids used by more than one card (a vector store rejects them)."""
    return cards.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def publish_cards(cards: DataFrame, path: str) -> None:
    """Rebuild the card collection: fail on duplicate ids, then overwrite the
    dataset partitioned by type (a type filter then prunes partitions)."""
    dups = duplicate_ids(cards)
    n = dups.count()
    if n:  # the message shows 20 of them, the driver never holds all
        raise ValueError(f"{n} duplicate card ids, among them {[r['id'] for r in dups.orderBy('id').limit(20).collect()]}")
    cards.write.mode("overwrite").partitionBy("type").parquet(path)


def enrich_item_cards(cards: DataFrame, extras: DataFrame) -> DataFrame:
    """Append keyword, neighbour, theme and text-priority sentences to item cards.

    ``extras`` is keyed by ``item`` and may carry any of ``keywords``,
    ``neighbours``, ``theme``, ``text_priority``; missing or empty values add
    nothing (a theme of 'unknown' neither).
    """
    e = extras.select("item", *[F.col(c).alias("_" + c) for c in
                                ("keywords", "neighbours", "theme", "text_priority") if c in extras.columns])

    def part(c: str, sentence) -> Column | None:
        return sentence if "_" + c in e.columns else None

    parts = [
        part("keywords", F.when(F.coalesce(F.col("_keywords"), F.lit("")) != "",
                                F.concat(F.lit("Keywords: "), F.col("_keywords"), F.lit("."))))
        if "_keywords" in e.columns else None,
        part("neighbours", F.when(F.coalesce(F.col("_neighbours"), F.lit("")) != "",
                                  F.concat(F.lit("Semantically similar skills: "), F.col("_neighbours"), F.lit("."))))
        if "_neighbours" in e.columns else None,
        part("theme", F.when(~F.coalesce(F.col("_theme"), F.lit("")).isin("", "unknown"),
                             F.concat(F.lit("Skill cluster theme: "), F.col("_theme"), F.lit("."))))
        if "_theme" in e.columns else None,
        part("text_priority", F.when(F.col("_text_priority") > 0,
                                     F.concat(F.lit("NLP-weighted gap priority: "), fmt("_text_priority", 3),
                                              F.lit("."))))
        if "_text_priority" in e.columns else None,
    ]
    parts = [p for p in parts if p is not None]
    extra = F.concat_ws(" ", *parts) if parts else F.lit("")
    j = cards.join(e, "item", "left")
    return j.withColumn("text", F.when(extra != "", F.concat(F.col("text"), F.lit(" "), extra))
                        .otherwise(F.col("text"))).select(*cards.columns)
