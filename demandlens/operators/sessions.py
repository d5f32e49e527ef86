"""Question-log operators (H1-H3): answer reuse by TTL, session tail, short queries.

H2 and H3 are window / expression operators.  H1 is a sequential fold per
cache key (an entry is written at a miss and is not refreshed by hits), so it
runs as a grouped Arrow UDF over each key's time-ordered events; the
streaming twins live in ``demandlens.streaming``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: cache lifetime, history cap, greeting words
ANSWER_TTL_SECONDS = 600
HISTORY_MAX_ITEMS = 40
GREETINGS = ["hi", "hello", "hey"]


def session_tail(messages: DataFrame, n: int = HISTORY_MAX_ITEMS, session: str = "session_id",
                 position: str = "position") -> DataFrame:
    """H2: the last ``n`` messages of every session (a per-session group limit)."""
    w = Window.partitionBy(session).orderBy(F.desc(position))
    return (messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
            .drop("_r"))


def is_simple_query(c) -> "F.Column":
    """H3: a greeting or at most two words (after lower/trim)."""
    q = F.lower(F.trim(c if not isinstance(c, str) else F.col(c)))
    return q.isin(*GREETINGS) | (F.size(F.split(q, r"\s+")) <= 2)


def cache_key(role, query) -> "F.Column":
    """H1 key: ``role:lower(trim(query))``."""
    r = role if not isinstance(role, str) else F.col(role)
    q = query if not isinstance(query, str) else F.col(query)
    return F.concat_ws(":", r, F.lower(F.trim(q)))


REUSE_SCHEMA = "key string, event_id long, ts timestamp, hit boolean, entry_ts timestamp"


def fold_anchors(t, ttl_us: int):
    """Sequential TTL fold of one key's sorted times (µs), vectorised.

    ``nxt[i]`` = first event later than t[i] + TTL (``searchsorted``); the
    anchors (misses that write the entry) are the chain 0 → nxt[0] → …, so
    the Python loop runs once per miss, not once per event.  Returns
    (hit flags, entry time of every event).
    """
    import numpy as np

    n = len(t)
    nxt = np.searchsorted(t, t + ttl_us, side="right")
    anchor = np.zeros(n, dtype=bool)
    i = 0
    while i < n:
        anchor[i] = True
        i = int(nxt[i])
    last = np.maximum.accumulate(np.where(anchor, np.arange(n), 0))
    return ~anchor, t[last]


def _fold(ttl_us: int):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        # several keys share one group (a hash bucket): fold each key's sorted run
        pdf = pdf.sort_values(["key", "ts", "event_id"], kind="mergesort").reset_index(drop=True)
        t = pdf["ts"].astype("int64").to_numpy() // 1000  # ns → µs
        keys = pdf["key"].to_numpy()
        hit = np.zeros(len(pdf), dtype=bool)
        entry = np.zeros(len(pdf), dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(pdf) else np.array([], int)
        ends = np.r_[starts[1:], len(pdf)]
        for a, b in zip(starts, ends):
            h, e = fold_anchors(t[a:b], ttl_us)
            hit[a:b] = h
            entry[a:b] = e
        out = pdf[["key", "event_id", "ts"]].copy()
        out["hit"] = hit
        out["entry_ts"] = pd.to_datetime(entry * 1000)
        return out
    return fold


def answer_reuse(log: DataFrame, ttl_seconds: int = ANSWER_TTL_SECONDS,
                 buckets: int | None = None) -> DataFrame:
    """H1: per event, whether a cached answer ≤ ``ttl_seconds`` old existed.

    ``log`` has (key, event_id, ts).  The first event of a key is a miss and
    writes the entry; later events are hits while ts - entry_ts ≤ TTL, and the
    first event past it is a miss that rewrites the entry.
    """
    ttl_us = int(ttl_seconds) * 1_000_000
    n = buckets or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    # many keys per group (hash buckets) so the per-group overhead is paid per bucket
    b = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("_bucket")
    return (log.select("key", "event_id", "ts", b)
            .groupBy("_bucket").applyInPandas(_fold(ttl_us), REUSE_SCHEMA))


SUMMARY_SCHEMA = ("_pid int, key string, head_t array<long>, head_out array<long>, "
                  "n long, last_t long")
STATE_SCHEMA = "_pid int, key string, a_in long"


def _segment_fold(t, ttl_us: int, a_in):
    """Fold one key segment given the incoming entry time ``a_in`` (µs or None)."""
    n = len(t)
    if a_in is None:
        k = 0
    else:
        k = int(np.searchsorted(t, a_in + ttl_us, side="right"))
    hit = np.ones(n, dtype=bool)
    entry = np.full(n, a_in if a_in is not None else 0, dtype=np.int64)
    if k < n:
        h, e = fold_anchors(t[k:], ttl_us)
        hit[k:], entry[k:] = h, e
    return hit, entry


def _out_entries(t, ttl_us: int, upto: int):
    """out[s] = the entry time after folding t[s:] when t[s] is a miss, for s < upto.

    Every restart jumps to the first event beyond its lifetime; all heads follow their chains at once, by
    doubling: a jump table is composed with itself until every chain has ended."""
    n = len(t)
    jump = np.searchsorted(t, t + ttl_us, side="right")
    # last miss reached from each event by 1, 2, 4, ... misses; n stands for "past the end"
    last = np.append(np.arange(n), n)
    jump = np.append(jump, n)
    while (jump[:upto] < n).any():
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return t[last[:upto]]


def _segments(pdf: pd.DataFrame):
    keys = pdf["key"].to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(pdf) else np.array([], int)
    return starts, np.r_[starts[1:], len(pdf)]


def _summaries(ttl_us: int):
    def run(batches):
        pdf = pd.concat(list(batches), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(["key", "t", "event_id"], kind="mergesort").reset_index(drop=True)
        starts, ends = _segments(pdf)
        t_all = pdf["t"].to_numpy()
        pid = int(pdf["_pid"].iloc[0])
        # only the first and the last key of a partition can continue in a neighbour
        for a, b in {(starts[0], ends[0]), (starts[-1], ends[-1])}:
            t = t_all[a:b]
            head = int(np.searchsorted(t, t[0] + ttl_us, side="right"))
            upto = min(len(t), head + 1)   # the head plus the first event after it
            out = _out_entries(t, ttl_us, upto)
            yield pd.DataFrame({"_pid": [pid], "key": [pdf["key"].iloc[a]],
                                "head_t": [t[:upto].tolist()], "head_out": [out.tolist()],
                                "n": [len(t)], "last_t": [int(t[-1])]})
    return run


def _chain(ttl_us: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pid")
        a = None
        rows = []
        for pid, key, ht, ho, n in zip(pdf["_pid"], pdf["key"], pdf["head_t"], pdf["head_out"], pdf["n"]):
            rows.append((int(pid), key, a))
            ht = np.asarray(ht, dtype=np.int64)
            ho = np.asarray(ho, dtype=np.int64)
            if a is None:
                a = int(ho[0])
            else:
                s = int(np.searchsorted(ht, a + ttl_us, side="right"))
                if s < n:
                    a = int(ho[s])
        return pd.DataFrame(rows, columns=["_pid", "key", "a_in"]).astype({"a_in": "Int64"})
    return run


def _apply_states(ttl_us: int):
    def run(batches):
        last_key, carried = None, None  # rows come sorted; a key goes on with the entry it had
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.reset_index(drop=True)
            starts, ends = _segments(pdf)
            t_all, keys = pdf["t"].to_numpy(), pdf["key"].to_numpy()
            a_all = pdf["a_in"].to_numpy()
            hit = np.zeros(len(pdf), dtype=bool)
            entry = np.zeros(len(pdf), dtype=np.int64)
            for a, b in zip(starts, ends):
                a_in = carried if keys[a] == last_key else a_all[a]
                a_in = None if pd.isna(a_in) else int(a_in)
                h, e = _segment_fold(t_all[a:b], ttl_us, a_in)
                hit[a:b], entry[a:b] = h, e
                last_key, carried = keys[a], int(e[-1])
            out = pdf[["key", "event_id", "ts"]].copy()
            out["hit"] = hit
            out["entry_ts"] = pd.to_datetime(entry * 1000)
            yield out
    return run


def answer_reuse_ranged(log: DataFrame, ttl_seconds: int = ANSWER_TTL_SECONDS,
                        partitions: int | None = None) -> DataFrame:
    """H1 without any per-key group: the log is range-partitioned on (key, time),
    so a key holding a large share of all events spreads over many partitions.

    1. range-partition + sort, tag rows with their partition id, checkpoint
       (both passes must see the same partitions; also cuts the lineage);
    2. pass 1 summarises only the first and last key segment of each
       partition (the only ones that may continue in a neighbour): the times
       within TTL of the segment start and the entry time each restart leads to;
    3. per key, the segment summaries (at most two per partition) are chained
       to give each segment its incoming entry time;
    4. pass 2 folds every partition with those incoming states, broadcast as a
       table bounded by two rows per partition.
    """
    from demandlens.session import materialize

    spark = log.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ttl_us = int(ttl_seconds) * 1_000_000
    ts = F.col("ts").cast("timestamp")
    x = (log.select("key", "event_id", ts.alias("ts"), F.unix_micros(ts).alias("t"))
         .repartitionByRange(n, "key", "t", "event_id").sortWithinPartitions("key", "t", "event_id")
         .withColumn("_pid", F.spark_partition_id()))
    x = materialize(x)
    summ = x.mapInPandas(_summaries(ttl_us), SUMMARY_SCHEMA)
    states = summ.groupBy("key").applyInPandas(_chain(ttl_us), STATE_SCHEMA)
    j = x.join(F.broadcast(states), ["_pid", "key"], "left").sortWithinPartitions("key", "t", "event_id")
    return j.mapInPandas(_apply_states(ttl_us), REUSE_SCHEMA)
