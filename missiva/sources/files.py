"""Files in, text out: allow-list, size guard, deduplication by content, and an injected OCR engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions.patterns import strip

EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png")
MAX_BYTES = 20 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def accepted(files: DataFrame) -> DataFrame:
    """files (path, length, ...) with ext, file_type and the reason of a refusal (null where taken)."""
    ext = extension(F.col("path"))
    return files.withColumn("ext", ext).withColumns(
        {
            "file_type": F.when(ext == ".pdf", "pdf").otherwise("image"),
            "refused": F.when(~ext.isin(*EXTENSIONS), "extension").when(F.col("length") > MAX_BYTES, "size"),
        }
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return accepted(spark.read.format("binaryFile").load(path))


def stored(files: DataFrame) -> DataFrame:
    """files with sha256 and the name to store under: by content, so that writing a file again changes nothing."""
    key = F.sha2("content", 256)
    return files.withColumn("sha256", key).withColumn("stored_as", F.concat(key, extension(F.col("path"))))


def text_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with at least ten characters besides white space at the ends."""
    return df.filter(F.length(strip(F.col(text))) >= 10)


def recognise(files: DataFrame, engine: Callable[[bytes], tuple[str, float]], name: str) -> DataFrame:
    """sha256, text, confidence, engine, once for each content: the engine sees no content twice."""
    once = files.filter("refused is null").withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            results = [engine(bytes(c)) for c in df["content"]]
            yield pd.DataFrame({"sha256": df["sha256"], "text": [r[0] for r in results], "confidence": [r[1] for r in results], "engine": name})

    return once.select("sha256", "content").mapInPandas(run, "sha256 string, text string, confidence double, engine string")
