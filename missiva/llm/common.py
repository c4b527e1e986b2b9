"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java regular expression.
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Shuffle files go when the query that made them has ended (public, since Spark 4.1; no effect before).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, SparkSession] = {}
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests on one machine) a temporary folder of this machine is set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='missiva-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/missiva-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system layer."""
    _made.pop(path, None)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before
            return


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made inside leave no shuffle files behind; the session's own setting comes back after."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``written`` that nothing reads any more; None and other DataFrames are left alone."""
    for t in tables:
        if t is not None and (path := _tables.pop(t, None)):
            remove(t.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")


def with_global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the column ``name``: each row's place (from 0) in the given total order.

    Range partitions are sorted and written; each partition's row count, one number a partition, gives the offsets.
    """
    spark = df.sparkSession
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()),
        "index",
    )
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    bases, base = [], 0
    for p, n in counts:
        bases.append((int(p), base))
        base += n
    offsets = spark.createDataFrame(bases or [(0, 0)], "__part long, __base long")
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row a partition
        .withColumn(name, F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1))
        .drop("__part", "__base", "__at")
    )
