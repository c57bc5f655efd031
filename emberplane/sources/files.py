"""Parts of written tables: reading one, their sizes, ids that run on, staged replacement, exports."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share. Only local mode (tests) may leave spark.checkpoint.dir unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/emberplane-{uuid.uuid4().hex}/{tag}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """A written copy in the shared folder: it cuts the lineage and outlives any executor. Shuffle files of the finished
    write are released at once."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    back = spark.read.schema(df.schema).parquet(path)
    _made[back] = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables that `written` made and that nothing reads any more."""
    for df in tables:
        path = _made.pop(df, None) if df is not None else None
        if path:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            place = jvm.org.apache.hadoop.fs.Path(path).getParent()
            place.getFileSystem(session.sessionState().newHadoopConf()).delete(place, True)


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, ... in each group (without groups: in all), in the given order.

    One range shuffle; a row's number is its place in its sorted partition plus the rows that its group
    has in earlier partitions. No task holds a whole group. The order must be total."""
    keys = [*groups, *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()), "numbered")
    laid = laid.withColumn("part_", F.shiftright("at_", 33).cast("int"))
    counts = laid.groupBy(*groups, "part_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row per group and partition
    counts = counts.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    counts = counts.withColumnsRenamed({c: f"{c}_of_" for c in (*groups, "part_")})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in (*groups, "part_")]
    return laid.join(counts, same).select(*df.columns, (F.col("at_") - F.col("first_") + F.col("before_")).alias(name))


def assign_ids(df: DataFrame, order: list[str], name: str = "tree_id") -> DataFrame:
    """df with unique int32 ids 0 to n - 1 in a total order."""
    return numbered(df, [], order, name).withColumn(name, F.col(name).cast("int"))


def write_parts(df: DataFrame, part: Column, path: str, key: list[str] | None = None) -> None:
    """A folder for each value of `part`; its rows lie in several files (by `key`), so that no task writes a whole part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.withColumn("part", part).repartition(n, "part", *(key or [c for c in df.columns[:4]])).write.partitionBy("part").parquet(path)


def part_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Per part: part, n (rows), columns. The part comes from the folder's name, so no column is read."""
    df = spark.read.parquet(path)
    names = F.array(*(F.lit(c) for c in df.columns if c != "part"))
    return df.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", names.alias("columns"))


@contextmanager
def footer_statistics(spark: SparkSession) -> Iterator[None]:
    """Plans made within answer counts of whole Parquet files from their footers, which the executors read, and read no rows."""
    new = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def footer_counts(spark: SparkSession, path: str, partitions: list[str]) -> DataFrame:
    """Rows `n` by all of the partition columns (only by all of them do footers answer), from the footers of the files under `path`."""
    with footer_statistics(spark):
        return written(spark.read.parquet(path).groupBy(*partitions).agg(F.count("*").alias("n")), "counts")


def count_rows(spark: SparkSession, path: str) -> int | None:
    """All rows under `path`, from the footers; None where nothing is written."""
    try:
        with footer_statistics(spark):
            return spark.read.parquet(path).agg(F.count("*")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_part(spark: SparkSession, path: str, index: int, columns: list[str]) -> DataFrame:
    """Columns of one part; other parts and columns are not read."""
    df = spark.read.parquet(path)
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    return df.filter(F.col("part") == index).select(*columns)


def running_ids(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Ids that run on from part to part, in order within each."""
    return numbered(df, [], [part, *order], "row_id")


def write_with_summary(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write and measure in one pass."""
    seen = Observation()
    df.observe(seen, *(m.alias(k) for k, m in metrics.items())).write.parquet(path)
    return seen.get


def current_revision(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of the newest complete revision under `base`."""
    try:
        log = spark.read.parquet(f"{base}/log")
    except Exception as e:  # no revision yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(log.agg(F.max_by("path", "revision")).first()[0])


def replace_rows(df: DataFrame, base: str) -> int:
    """Write `df` beside the current revision, check its row count, then make it current by one appended
    log row. A reader never sees half of it, and `df` may read the revision that it replaces."""
    spark = df.sparkSession
    path = f"{base}/rows-{uuid.uuid4().hex}"
    n = write_with_summary(df, path, n=F.count(F.lit(1)))["n"]
    if spark.read.parquet(path).count() != n:
        raise RuntimeError(f"{path} lacks rows; the current revision stays")
    old = current_revision(spark, base)
    revision = 1 if old is None else spark.read.parquet(f"{base}/log").agg(F.max("revision")).first()[0] + 1
    spark.createDataFrame([(revision, path, n)], "revision long, path string, n long").write.mode("append").parquet(f"{base}/log")
    return revision


def export(df: DataFrame, columns: list[str], path: str, fmt: str) -> None:
    """Selected columns as Parquet or CSV with a header; an unknown column is an error."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    writer = df.select(*columns).write
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_index(df: DataFrame, columns: list[str], order: list[str], path: str, rows: int = 500) -> None:
    """A lookup table in range order, in files whose row groups are small enough to skip."""
    df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", rows).parquet(path)
