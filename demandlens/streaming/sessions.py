"""Structured Streaming twins of the question-log operators (H1, H2).

Both keep per-key state with ``transformWithStateInPandas``: the state of a
key is one small value (the entry time, or the last N messages), so it never
grows with the stream.  An event-time watermark decides which events are
late; Spark drops those before the state update.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from demandlens.operators.sessions import ANSWER_TTL_SECONDS, HISTORY_MAX_ITEMS, fold_anchors


def answer_reuse_stream(stream: DataFrame, ttl_seconds: int = ANSWER_TTL_SECONDS,
                        watermark: str = "1 hour") -> DataFrame:
    """H1 on a stream: keyed state holds the entry time; events arrive in
    micro-batches and are folded in event-time order within each batch
    (tested equal to the batch fold).

    Events later than the watermark are dropped by Spark before the state
    update, which is the streaming definition of "late".  A key's entry is removed by an event-time timer
    once the watermark has passed its lifetime: no later event can hit it, so state holds live entries only.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import (BooleanType, LongType, StringType, StructField, StructType,
                                   TimestampType)

    ttl_us = int(ttl_seconds) * 1_000_000
    out_schema = StructType([StructField("key", StringType()), StructField("event_id", LongType()),
                             StructField("ts", TimestampType()), StructField("hit", BooleanType()),
                             StructField("entry_ts", TimestampType())])

    class Reuse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.entry = handle.getValueState("entry", StructType([StructField("t", LongType())]))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.entry.exists() and (self.entry.get()[0] + ttl_us) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
            yield from ()

        def handleInputRows(self, key, rows, timerValues):
            pdf = pd.concat(list(rows), ignore_index=True)
            pdf = pdf.sort_values(["ts", "event_id"], kind="mergesort")
            anchor = self.entry.get()[0] if self.entry.exists() else None
            t = pdf["ts"].astype("int64").to_numpy() // 1000
            # events still covered by the carried entry are hits; the rest fold as in batch
            k = int(np.searchsorted(t, anchor + ttl_us, side="right")) if anchor is not None else 0
            hits = np.ones(len(t), dtype=bool)
            entry = np.full(len(t), anchor if anchor is not None else 0, dtype=np.int64)
            if k < len(t):
                h, e = fold_anchors(t[k:], ttl_us)
                hits[k:], entry[k:] = h, e
                anchor = int(e[-1])
            self.entry.update((anchor,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((anchor + ttl_us) // 1000 + 1)
            out = pdf[["key", "event_id", "ts"]].copy()
            out["hit"] = hits
            out["entry_ts"] = pd.to_datetime(pd.Series(entry, index=out.index) * 1000)
            yield out

        def close(self) -> None:
            pass

    return (stream.withWatermark("ts", watermark)
            .groupBy("key")
            .transformWithStateInPandas(Reuse(), out_schema, "append", "EventTime"))


def session_tail_stream(stream: DataFrame, n: int = HISTORY_MAX_ITEMS, session: str = "session_id",
                        position: str = "position", watermark: str = "1 hour",
                        event_time: str = "ts") -> DataFrame:
    """H2 on a stream: the state of a session is its last ``n`` messages; every
    micro-batch that touches a session emits the session's current tail
    (``snapshot`` = the batch's highest position), so the latest snapshot per
    session equals the batch ``session_tail``."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    out_schema = StructType([StructField(session, StringType()), StructField(position, LongType()),
                             StructField("text", StringType()), StructField("snapshot", LongType())])
    state_schema = StructType([StructField("pos", LongType()), StructField("text", StringType())])

    class Tail(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.tail = handle.getListState("tail", state_schema)

        def handleInputRows(self, key, rows, timerValues):
            new = pd.concat(list(rows), ignore_index=True)
            old = list(self.tail.get()) if self.tail.exists() else []
            pos = [int(p) for p, _ in old] + new[position].astype("int64").tolist()
            txt = [t for _, t in old] + new["text"].tolist()
            keep = sorted(zip(pos, txt), key=lambda x: x[0])[-n:]
            self.tail.put(keep)
            snap = keep[-1][0]
            yield pd.DataFrame({session: [key[0]] * len(keep), position: [p for p, _ in keep],
                                "text": [t for _, t in keep], "snapshot": [snap] * len(keep)})

        def close(self) -> None:
            pass

    return (stream.withWatermark(event_time, watermark)
            .groupBy(session)
            .transformWithStateInPandas(Tail(), out_schema, "append", "EventTime"))
