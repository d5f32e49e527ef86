"""Versioned card collection (S5): write, check what was written, publish by a pointer.

``rebuild()`` writes a new version beside the old ones, with unit vectors and a metadata map,
partitioned by card type.  It then reads the version back and checks it: ids present and
unique, one vector length, no vector without a direction being scaled.  Only then is the file ``CURRENT`` replaced,
in one rename.  A reader resolves the pointer once and keeps its version: a rebuild that
fails, or a driver that is lost between the steps, leaves the published version as it was.  ``prune()`` removes
versions that no reader should need any more.

The rename is atomic on HDFS and local file systems; on an object store without atomic rename a
reader may have to retry, but never sees half a version.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.operators.vectors import norm, unit

POINTER = "CURRENT"
COLUMNS = ("id", "text", "priority_score", "meta", "embedding", "type")


def metadata(**fields: Column) -> Column:
    """A card's metadata map; fields whose value is null are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def _version_path(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}"


def write_version(cards: DataFrame, path: str) -> str:
    """Writes the cards as a new, unpublished version and returns its name."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    empty = F.create_map().cast("map<string,string>")
    meta = F.coalesce(F.col("meta"), empty) if "meta" in cards.columns else empty
    rows = cards.withColumn("meta", meta).withColumn("embedding", unit(F.col("embedding").cast("array<double>")).cast("array<float>"))
    rows.select(*COLUMNS).write.partitionBy("type").parquet(_version_path(path, version))
    return version


def check_version(spark: SparkSession, path: str, version: str) -> None:
    """Raises ValueError unless the written ids are present and unique and all vectors have one length
    and unit norm (or are zero)."""
    rows = spark.read.parquet(_version_path(path, version))
    length = norm(F.col("embedding").cast("array<double>"))
    s = rows.agg(F.count_if(F.col("id").isNull()).alias("no_id"), F.count_distinct(F.coalesce(F.size("embedding"), F.lit(-1))).alias("sizes"),
                 F.count_if(F.col("embedding").isNull() | ((F.abs(length - 1) > 1e-4) & (length > 0))).alias("odd")).first()
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = twice.count()
    if n:  # the message shows 20 of them, the driver never holds all
        raise ValueError(f"{n} duplicate card ids, among them {[r['id'] for r in twice.orderBy('id').limit(20).collect()]}")
    if s["no_id"] or s["odd"] or s["sizes"] > 1:
        raise ValueError(f"{s['no_id']} cards without id, {s['odd']} without a unit vector, {s['sizes']} vector lengths")


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Points readers at a version: a file written beside the pointer takes its place in one rename."""
    jvm = spark.sparkContext._jvm
    pointer, fs = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    beside, _ = _fs(spark, f"{path.rstrip('/')}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(beside, pointer, options)


def rebuild(cards: DataFrame, path: str) -> str:
    """A new version of the collection, checked, then published; returns its name.

    ``cards`` has id, type, text, priority_score, embedding and, if given, meta (map of strings).  When a check fails,
    the version stays unpublished and readers keep the old one.
    """
    spark = cards.sparkSession
    version = write_version(cards, path)
    check_version(spark, path, version)
    publish(spark, path, version)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the published version; None before the first."""
    pointer, fs = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    return spark.read.text(pointer.toString()).first()[0]


def read_collection(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """The published cards; ``types`` reads only those types' folders (partition pruning)."""
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"no published version in {path}")
    rows = spark.read.parquet(_version_path(path, version)).withColumn("type", F.col("type").cast("string"))
    return rows.where(F.col("type").isin(*types)) if types is not None else rows


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of all versions, oldest first (a folder each, few)."""
    folder, fs = _fs(spark, f"{path.rstrip('/')}/versions")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes all but the ``keep`` newest versions, never the published one; returns what went."""
    names, now = versions(spark, path), current_version(spark, path)
    gone = [v for v in names[:-keep or None] if v != now]
    for v in gone:
        folder, fs = _fs(spark, _version_path(path, v))
        fs.delete(folder, True)
    return gone
