"""A durable table of records: updates, deletions and inserts are written back, and a rerun after a crash leaves the same table.

Rows lie in ``buckets`` partitions by their id's hash. A change reads and rewrites only the buckets that its ids name: the
new buckets are first written whole beside the table, then a list of them, and only when both are there do they take the
place of the table's own, folder by folder and by renaming, so that a row is written once. A crash before that leaves the
table as it was; a crash during it is mended by recover(), which every operation runs first and which ends the
replacement by the list. Inserts append rows whose content key isn't there yet, so that a rerun adds nothing twice; an
appended row is whole or absent. Whole rows are exchanged once a change, by id; keys alone decide which rows are new.

One writer at a time. Nulls in any column are kept; an empty patch, insert or deletion changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.operators import records
from missiva.sources.shared import exists, remove, renamed, scratch

BUCKETS = 64
#: What makes two records the same for an insert.
CONTENT = ("filename", "texte_complet")
OWN = ("bucket", "content_key")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(buckets)).cast("int")


def content_key(df: DataFrame, columns: tuple[str, ...] = CONTENT) -> Column:
    """SHA-256 of the columns that make a record, with nulls apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*(c for c in columns if c in df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


class RecordTable:
    """``path`` is a folder that all executors share; ``columns`` make the content key."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = BUCKETS, columns: tuple[str, ...] = CONTENT):
        self.spark, self.path, self.buckets, self.columns = spark, path.rstrip("/"), buckets, columns
        self.data, self.next, self.ready, self.kind = (f"{self.path}/{x}" for x in ("rows", "next", "ready", "schema"))

    # --- reading

    def _read(self, path: str) -> DataFrame:
        """With the schema of a table without rows that lies beside it, for a table may lose its last bucket."""
        return self.spark.read.schema(self.spark.read.parquet(self.kind).schema).parquet(path)

    def _stored(self) -> DataFrame:
        self.recover()
        return self._read(self.data)

    def rows(self) -> DataFrame:
        return self._stored().drop(*OWN)

    def lookup(self, key: int) -> DataFrame:
        """The row with this id, from its one bucket."""
        bucket = self.spark.range(1).select(bucket_of(F.lit(key), self.buckets)).first()[0]
        return self._stored().filter((F.col("bucket") == bucket) & (F.col("id") == key)).drop(*OWN)

    # --- writing

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"content_key": content_key(df, self.columns), "bucket": bucket_of(F.col("id"), self.buckets)})

    def create(self, df: DataFrame) -> None:
        """Writes the first rows; each bucket is sorted by id, so that a row group's range of ids is narrow."""
        placed = self._placed(df)
        placed.limit(0).coalesce(1).write.mode("overwrite").parquet(self.kind)
        placed.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(self.data)

    def insert(self, df: DataFrame) -> None:
        """Appends the rows whose content and id aren't there; of equal new contents the least id, of equal ids the least content key."""
        placed = self._placed(df)
        one = placed.groupBy("content_key").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("content_key").alias("content_key"))
        there = self._stored().select("content_key", "id")
        path = scratch(self.spark, "new")
        one.join(there.select("content_key"), "content_key", "left_anti").join(there.select("id"), "id", "left_anti").write.parquet(path)
        keys = self.spark.read.schema(one.schema).parquet(path)
        if not keys.isEmpty():
            new = placed.join(keys, ["content_key", "id"], "left_semi").dropDuplicates(["content_key", "id"])
            new.select(self._read(self.data).columns).repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("append").partitionBy("bucket").parquet(self.data)
        remove(self.spark, path)

    def update(self, patches: DataFrame) -> None:
        """records.update, written back; the content key follows the new values."""
        self._change(patches.select("id"), lambda rows: records.update(rows, patches))

    def delete(self, ids: DataFrame) -> None:
        self._change(ids.select("id"), lambda rows: records.delete(rows, ids))

    def _change(self, ids: DataFrame, change) -> None:
        stored = self._stored()
        buckets = sorted(r[0] for r in ids.select(bucket_of(F.col("id"), self.buckets)).distinct().collect() if r[0] is not None)  # at most ``buckets`` numbers
        if not buckets:
            return
        before = stored.filter(F.col("bucket").isin(buckets)).drop(*OWN).repartition("id")  # the one exchange of whole rows, which the change's join keeps to
        self._placed(change(before)).sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(self.next)
        left = [(b, exists(self.spark, f"{self.next}/bucket={b}")) for b in buckets]
        self.spark.createDataFrame(left, "bucket int, left boolean").coalesce(1).write.mode("overwrite").parquet(self.ready)
        self._replace()

    def recover(self) -> None:
        """Ends a replacement that a crash cut short, or drops a copy that wasn't whole."""
        if exists(self.spark, f"{self.ready}/_SUCCESS"):
            self._replace()
        else:
            remove(self.spark, self.next)
            remove(self.spark, self.ready)

    def _replace(self) -> None:
        """Puts the copy's buckets in the table's place; may run again at any point."""
        for bucket, left in self.spark.read.parquet(self.ready).collect():  # at most ``buckets`` numbers
            old, new = (f"{path}/bucket={bucket}" for path in (self.data, self.next))
            if exists(self.spark, new):
                remove(self.spark, old)
                renamed(self.spark, new, old)
            elif not left:  # all its rows are deleted; else it is in its place already
                remove(self.spark, old)
        remove(self.spark, f"{self.ready}/_SUCCESS")  # first, so that a list half removed isn't replayed
        remove(self.spark, self.ready)
        remove(self.spark, self.next)
