"""Confidence and review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions.patterns import rx
from missiva.operators.scan_fields import FIELDS

# Base scores, with an arrival stamp where that counts, and the router's limits.
BASE = {"objet": 0.80, "expediteur": 0.85, "destinataire": 0.85, "etablissement": 0.90}
MANUAL, REVIEW = 0.60, 0.90
ODD = r"[^\w\s\x{0600}-\x{06FF}\-,'.:/À-ÿ]"


def score_scan(field: str, value: Column, has_stamp: Column) -> Column:
    """Doubles, subtracted in this order."""
    if field == "type_document":
        return F.when(value.isNull(), 0.0).when(value == "lettre", 0.55).otherwise(0.85)
    if field == "numero":
        base = F.when(has_stamp, 0.90).otherwise(0.70)
    elif field == "date":
        base = F.when(has_stamp, 0.95).otherwise(0.85)
    else:
        base = F.lit(BASE[field])
    base = base - F.when(F.length(value) < 5, 0.15).otherwise(0.0)
    base = base - F.when(F.length(value) > 200, 0.05).otherwise(0.0)
    base = base - F.when(F.regexp_count(value, F.lit(rx(ODD))) > 3, 0.10).otherwise(0.0)
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))




def percent(score: Column) -> Column:
    return (score * 100).cast("int")


def route(value: Column, score: Column) -> Column:
    """struct(action, color, value)."""
    low = value.isNull() | (score < MANUAL)
    return F.struct(
        F.when(low, "manual").when(score < REVIEW, "review").otherwise("auto").alias("action"),
        F.when(low, "red").when(score < REVIEW, "yellow").otherwise("green").alias("color"),
        F.when(~low, value).alias("value"),
    )


def scored(df: DataFrame) -> DataFrame:
    """df (from extract) as one row per field: id, field, value, score, percent, action, color, shown."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), score_scan(f, F.col(f), F.col("has_stamp")).alias("score")) for f in FIELDS))
    out = df.select("id", F.explode(rows).alias("r")).select("id", "r.*")
    hint = route(F.col("value"), F.col("score"))
    return out.withColumns({"percent": percent(F.col("score")), "hint": hint}).select("id", "field", "value", "score", "percent", "hint.action", "hint.color", F.col("hint.value").alias("shown"))


def review_queue(fields: DataFrame) -> DataFrame:
    return fields.groupBy("field", "action").agg(F.count("*").alias("n"))
