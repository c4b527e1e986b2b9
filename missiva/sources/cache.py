"""Recognised texts that last: each content meets an engine once, in this run or any earlier one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.sources.files import recognise
from missiva.sources.shared import exists

SCHEMA = "sha256 string, text string, confidence double, batch string, engine string, part string"


class RecognitionCache:
    """A table at ``path``, a folder that all executors share, by engine and by the first digit of the content's SHA-256.

    New results are appended by tasks that either end whole or leave nothing, so a run that is killed keeps the results of
    the jobs that ended, and a rerun asks the engine for the others only. Results that two runs made side by side count once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, engine: str) -> DataFrame:
        """sha256, text, confidence, batch: one row a content."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA).drop("engine", "part")
        held = self.spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("engine") == engine)
        first = held.groupBy("sha256").agg(F.min(F.struct("batch", "text", "confidence")).alias("r"))
        return first.select("sha256", "r.text", "r.confidence", "r.batch")

    def missing(self, files: DataFrame, engine: str) -> DataFrame:
        """Files whose content the engine hasn't seen; contents aren't shuffled, for the cache's keys go to them where they are few."""
        keyed = files.withColumn("sha256", F.sha2("content", 256))
        return keyed.join(self.rows(engine).select("sha256"), "sha256", "left_anti")

    def recognised(self, files: DataFrame, engine: Callable[[bytes], tuple[str, float]], name: str, batch: str = "") -> DataFrame:
        """files without their content, with sha256, text, confidence and batch (that of the run which recognised it); refused files have nulls."""
        new = recognise(self.missing(files, name), engine, name).withColumns({"batch": F.lit(batch), "part": F.substring("sha256", 1, 1)})
        new.write.mode("append").partitionBy("engine", "part").parquet(self.path)
        keyed = files.withColumn("sha256", F.when(F.col("refused").isNull(), F.sha2("content", 256))).drop("content")
        return keyed.join(self.rows(name), "sha256", "left")
