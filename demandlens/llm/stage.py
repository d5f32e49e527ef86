"""Written intermediate tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.session import checkpoint_dir

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
TASK_BYTES = 64 << 20

def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written once as Parquet under the shared checkpoint folder and read again: cuts the
    lineage, survives lost executors, and keeps column pruning for the readers."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(texts: DataFrame, text_col: str = "text") -> int:
    """How many tasks a shuffle of packed parts takes: spark.sql.shuffle.partitions, or more, so that a task has
    at most TASK_BYTES of text on average."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-size // TASK_BYTES))


def dealt(packed: DataFrame, tasks: int) -> DataFrame:
    """Rows sorted by part, part p in task p mod ``tasks``: every task has as many parts as any other."""
    return packed.repartitionById(tasks, "part").sortWithinPartitions("part")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session has a setting of its own: a batch of whole texts is held
    several times, on both sides of a Python worker."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def by_part(batches) -> Iterator[list[tuple]]:
    """The rows (without the first column, by which they are sorted) of one part at a time."""
    rows: list[tuple] = []
    now = None
    for b in batches:
        part = b.column(0).to_pylist()
        for r in range(b.num_rows):
            if part[r] != now and rows:
                yield rows
                rows = []
            now = part[r]
            rows.append(tuple(c[r].as_py() for c in b.columns[1:]))
    if rows:
        yield rows


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes to be no column of df (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id connected to each id of the edges.

    Large-star and small-star steps in turn, as aggregations and joins on the node (hot nodes
    are pre-aggregated, and their join partitions are split by adaptive execution), until
    every edge points at its component's smallest id.  Each round is written to the shared
    folder; no edge or label ever travels to the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = staged(e, "cc")
    while True:
        # large star: each neighbour above u goes to u's smallest neighbour (or u itself)
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        up = e.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = staged(up.join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
                       .filter("u <> v").distinct(), "cc")
        # small star: neighbours below u, and u, go to u's smallest neighbour
        m = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc")
        down = large.join(m.filter("n > 1").select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(down.unionAll(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
        # done when every node has one edge and no target has an edge of its own
        s = new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d")).first()
        if s["n"] == s["d"] and new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        e = new
    return new.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
