"""File sources and sinks of the model (S1, S2) with declared schemas and the
cleaning rules applied at read (P1-P3).

The demand log and the coverage catalogue arrive as CSV with a header; the
schemas are declared (no inference), numeric columns are cast with ANSI
semantics (a bad number fails the job; ``lenient=True`` uses ``try_cast`` and
keeps the row with a null instead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEMAND_CSV_SCHEMA = "Company string, Year string, Role string, Skill string, Skill_Type string"
COVERAGE_CSV_SCHEMA = "Institute string, Semester string, Course string, Skill string"
UPCOMING_TYPE_NAME = "upcoming"
# what opening a file counts for when files are put together into tasks; Spark's own 4 MB gives a task to every few small files
OPEN_SETTING, OPEN_BYTES = "spark.sql.files.openCostInBytes", 64 << 10
# every task moves its own files into place; otherwise the driver moves all of them one after the other
COMMIT_BY_TASK = ("mapreduce.fileoutputcommitter.algorithm.version", "2")
NO_NAME = "__HIVE_DEFAULT_PARTITION__"   # of the file without a name, as Spark's writer calls it


def _num(c: str, lenient: bool):
    return F.expr(f"try_cast({c} AS INT)") if lenient else F.col(c).cast("int")


def read_demand_csv(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """S1 + P1-P3: (company, year, role, item, item_type, upcoming_flag)."""
    raw = spark.read.schema(DEMAND_CSV_SCHEMA).option("header", True).csv(path)
    return raw.select(
        F.col("Company").alias("company"),
        _num("Year", lenient).alias("year"),
        F.col("Role").alias("role"),
        F.lower(F.trim("Skill")).alias("item"),
        F.col("Skill_Type").alias("item_type"),
        (F.lower(F.col("Skill_Type")) == UPCOMING_TYPE_NAME).cast("int").alias("upcoming_flag"))


def read_coverage_csv(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """S1 + P1: (provider, semester, course, item); provider lower/trim, item lower/trim."""
    raw = spark.read.schema(COVERAGE_CSV_SCHEMA).option("header", True).csv(path)
    return raw.select(
        F.lower(F.trim("Institute")).alias("provider"),
        F.coalesce(_num("Semester", True) if lenient else F.col("Semester").cast("int"), F.lit(0)).alias("semester"),
        F.trim("Course").alias("course"),
        F.lower(F.trim("Skill")).alias("item"))


def _scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with its header skipped; a line with too few or too many fields is kept whole in ``_line``."""
    return (spark.read.schema(schema + ", _line string").option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_line").option("columnPruning", False).csv(path))


def _blank(c: str):
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def demand_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1 + P1-P3: (rows, rejected).  ``rows`` as ``read_demand_csv``; ``rejected`` is the dead letter: (reason, line) of
    what that would fail on or keep without a key: ``fields`` (wrong number of fields),
    ``year`` (not a whole number) or ``item`` (blank).  Every line is in exactly one of the two."""
    raw = _scan(spark, path, DEMAND_CSV_SCHEMA)
    year = F.expr("try_cast(trim(Year) AS INT)")
    reason = F.when(F.col("_line").isNotNull(), "fields").when(year.isNull(), "year").when(_blank("Skill"), "item")
    rows = raw.where(reason.isNull()).select(
        F.col("Company").alias("company"), year.alias("year"), F.col("Role").alias("role"), F.lower(F.trim("Skill")).alias("item"),
        F.col("Skill_Type").alias("item_type"),
        F.coalesce(F.lower(F.trim("Skill_Type")) == UPCOMING_TYPE_NAME, F.lit(False)).cast("int").alias("upcoming_flag"))
    return rows, _rejected(raw, reason, "Company", "Year", "Role", "Skill", "Skill_Type")


def coverage_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1 + P1: (rows, rejected), likewise; a blank semester is 0 (unknown), any other that is no whole number is rejected."""
    raw = _scan(spark, path, COVERAGE_CSV_SCHEMA)
    number = F.expr("try_cast(trim(Semester) AS INT)")
    reason = (F.when(F.col("_line").isNotNull(), "fields").when(number.isNull() & ~_blank("Semester"), "semester")
              .when(_blank("Skill"), "item"))
    rows = raw.where(reason.isNull()).select(
        F.lower(F.trim("Institute")).alias("provider"), F.coalesce(number, F.lit(0)).alias("semester"),
        F.trim("Course").alias("course"), F.lower(F.trim("Skill")).alias("item"))
    return rows, _rejected(raw, reason, "Institute", "Semester", "Course", "Skill")


def _rejected(raw: DataFrame, reason, *cols: str) -> DataFrame:
    line = F.coalesce(F.col("_line"), F.to_csv(F.struct(*cols)))
    return raw.where(reason.isNotNull()).select(reason.alias("reason"), line.alias("line"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a dataset (CSV with a header, or Parquet), optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_text_files(df: DataFrame, folder: str, end: str = "") -> list[str]:
    """S3's counterpart: one file for each name of ``df`` (name, text), with ``end`` behind its text; texts of one name follow
    each other in one file.  Returns the folders that hold the files, for ``read_text_files``; ``file_name`` tells the names.

    On a file system that is mounted (``file:``) the tasks write the files themselves, each attempt into a folder of its own, and
    only the folders of the attempts that count are returned: Hadoop's client starts a chmod process for every
    file and folder it makes there.  Texts are shuffled only where a name comes twice.  Any other store is written by Spark, with a partition folder for each name.
    """
    rows = df.select(F.col("name").cast("string").alias("name"), "text")
    if not folder.startswith("file:"):
        rows.repartition("name").sortWithinPartitions("name").write.option("lineSep", end).option(*COMMIT_BY_TASK).partitionBy("name").text(folder)
        return [folder]
    root = "/" + folder.removeprefix("file:").lstrip("/")

    def write(batches):
        import os
        from urllib.parse import quote

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        os.makedirs(f"{root}/{part}")
        last, out = None, None
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = quote(name or NO_NAME, safe="")
                if name != last:
                    if out:
                        out.close()
                    last, out = name, open(f"{root}/{part}/name={name}.txt", "ab")   # readers skip files that begin with _ or .
                out.write(f"{text or ''}{end}".encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part])], ["part"])

    if not rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():   # texts of one name meet in one task
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "name").sortWithinPartitions("name")
    done = rows.mapInArrow(write, "part string").collect()   # a row per task
    if not done:   # a plan known to be empty has no tasks
        import os

        os.makedirs(root)
    return [f"{folder}/{r['part']}" for r in done] or [folder]


def file_name(path: str | Column) -> Column:
    """The name that ``write_text_files`` was given for the file of a path."""
    p = F.col(path) if isinstance(path, str) else path
    folder = F.regexp_extract(p, "/name=([^/]+)/[^/]*$", 1)
    own = F.regexp_extract(p, "/name=([^/]+)\\.txt$", 1)
    return F.when(folder != "", folder).otherwise(F.url_decode(own))


def read_text_files(spark: SparkSession, folder: str | list[str], glob: str = "*.txt",
                    recursive: bool = False) -> DataFrame:
    """S3: every file of a folder (or of several) that matches ``glob``, as (doc_id, path, text), UTF-8.

    Spark lists and reads the files in parallel (``binaryFile``), some hundreds of small ones in a task unless the
    session has an open cost of its own.  The order of
    the original (files sorted by name) is the ``path`` column itself: later
    steps order by it, nothing is ranked over the whole listing.
    """
    if OPEN_SETTING not in spark.conf.getAll:
        spark.conf.set(OPEN_SETTING, str(OPEN_BYTES))
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", str(recursive).lower()).load(folder))
    return raw.select(F.xxhash64("path").alias("doc_id"), "path",
                      F.decode(F.col("content"), "UTF-8").alias("text"))
