"""What a chain did at each stage, observed by the action that runs it: no stage is run twice for its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from missiva.functions.normalise import normalise_scan
from missiva.operators.scan_fields import FIELDS, extract

SCHEMA = "place int, stage string, rows long, characters long, fields long"


def found(fields: tuple[str, ...] = FIELDS) -> Column:
    """How many of the fields have a value."""
    none = F.lit(0)
    for f in fields:
        none = none + F.col(f).isNotNull().cast("int")
    return none


class Stages:
    """Observations along a chain; ``table`` waits for the action and gives a row a stage, in order.

    Rows that a retried task saw twice count once. Characters and fields of a stage without rows are 0.
    """

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation]] = []

    def observed(self, df: DataFrame, stage: str, text: str, fields: Column | None = None) -> DataFrame:
        observation = Observation(f"{len(self.seen)}-{stage}")
        self.seen.append((stage, observation))
        length = F.sum(F.length(F.coalesce(F.col(text), F.lit(""))))
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), length.alias("characters"), F.sum(F.lit(0) if fields is None else fields).alias("fields"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, stage, *(o.get[c] or 0 for c in ("rows", "characters", "fields"))) for i, (stage, o) in enumerate(self.seen)]
        return spark.createDataFrame(rows, SCHEMA)


def measured_scan(df: DataFrame, stages: Stages, text: str = "texte_complet") -> DataFrame:
    """The scan profile with its stages observed: the text as it came, as it was corrected, and the fields read from it."""
    came = stages.observed(df, "text", text)
    fixed = stages.observed(came.withColumn(text, normalise_scan(F.coalesce(F.col(text), F.lit("")))), "corrected", text)
    return stages.observed(extract(fixed, text), "fields", "corps", found())
