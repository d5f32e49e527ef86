"""Structured Streaming twin of H1 equals the batch answer (availableNow over a file source)."""

import datetime as dt
import random
import tempfile

from demandlens.operators import sessions as se
from demandlens.streaming import sessions as st


def test_answer_reuse_stream_equals_batch(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for key in ("a", "b", "c"):
        t = 0
        for _ in range(25):
            t += rnd.choice([30, 200, 590, 600, 601, 900])
            rows.append((key, eid, t0 + dt.timedelta(seconds=t)))
            eid += 1
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    src = tempfile.mkdtemp(prefix="dl-stream-src-")
    df.repartition(1).write.mode("overwrite").parquet(src)

    batch = {r["event_id"]: (r["hit"], r["entry_ts"]) for r in se.answer_reuse(df, 600).collect()}

    stream = spark.readStream.schema(df.schema).parquet(src)
    out = st.answer_reuse_stream(stream, 600, watermark="1 day")
    q = (out.writeStream.format("memory").queryName("reuse_stream").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="dl-stream-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["event_id"]: (r["hit"], r["entry_ts"]) for r in spark.table("reuse_stream").collect()}
    assert got == batch


def test_session_tail_stream_equals_batch(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 4}", i, f"m{i}", t0 + dt.timedelta(seconds=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, position long, text string, ts timestamp")
    src = tempfile.mkdtemp(prefix="dl-stream-src-")
    df.repartition(1).write.mode("overwrite").parquet(src)
    want = sorted((r["session_id"], r["position"]) for r in se.session_tail(df, 3).collect())
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (st.session_tail_stream(stream, 3, watermark="1 day").writeStream.format("memory")
         .queryName("tail_stream").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="dl-stream-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    rows = spark.table("tail_stream").collect()
    latest = {}
    for r in rows:
        latest[r["session_id"]] = max(latest.get(r["session_id"], -1), r["snapshot"])
    got = sorted((r["session_id"], r["position"]) for r in rows if r["snapshot"] == latest[r["session_id"]])
    assert got == want
