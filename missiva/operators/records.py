"""Filters, search, paging, updates and statistics over the table of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEARCH_FIELDS = {
    "objet": ("objet",),
    "contenu": ("texte_complet", "corps"),
    "expediteur": ("expediteur",),
    "destinataire": ("destinataire",),
}
ALL_FIELDS = ("objet", "numero", "expediteur", "destinataire", "texte_complet", "corps")
UPDATABLE = ("numero", "date_courrier", "objet", "expediteur", "destinataire", "type_document", "corps", "status", "validated_by")

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        *(T.StructField(n, T.StringType(), False) for n in ("filename", "file_path", "file_type")),
        *(
            T.StructField(n, T.StringType())
            for n in ("numero", "date_courrier", "objet", "expediteur", "destinataire", "type_document", "etablissement", "corps", "texte_complet", "langue_detectee")
        ),
        T.StructField("confidence", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("status", T.StringType()),
        T.StructField("validated_by", T.StringType()),
        T.StructField("processing_time_ms", T.IntegerType()),
        T.StructField("ocr_engine_used", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def with_status(df: DataFrame, status: str | None) -> DataFrame:
    return df.filter(F.col("status") == status) if status else df


def newest(df: DataFrame) -> list[Column]:
    """Latest first; ids part equal times."""
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def page(df: DataFrame, number: int = 1, size: int = 20, status: str | None = None) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("number is 1 or more, size 1 to 100")
    return with_status(df, status).orderBy(*newest(df)).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int = 20, status: str | None = None) -> DataFrame:
    return with_status(df, status).agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def search(df: DataFrame, query: str, field: str = "all", limit: int = 50) -> DataFrame:
    """Case-blind containment; % and _ in the query stay wildcards; the newest ``limit`` rows."""
    pattern = "%" + query.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for name in SEARCH_FIELDS.get(field, ALL_FIELDS):
        hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return df.filter(hit).orderBy(*newest(df)).limit(limit)


def lookup(df: DataFrame, key: int) -> DataFrame:
    return df.filter(F.col("id") == key)


def update(df: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: id, seq, fields map<string,string>; the last patch of an id counts, and a key with null overwrites."""
    last = patches.groupBy("id").agg(F.max_by("fields", "seq").alias("_fields"), F.max_by("at", "seq").alias("_at"))
    joined = df.join(last, "id", "left")
    patched = F.col("_fields").isNotNull()
    changed = {c: F.when(patched & F.map_contains_key("_fields", c), F.try_element_at("_fields", F.lit(c))).otherwise(F.col(c)) for c in UPDATABLE if c in df.columns}
    if "updated_at" in df.columns:
        changed["updated_at"] = F.when(patched, F.col("_at")).otherwise(F.col("updated_at"))
    return joined.withColumns(changed).select(*df.columns)


def pending(df: DataFrame) -> DataFrame:
    """New rows in SCHEMA's columns with status pending; ``date`` is date_courrier, columns that df hasn't are null."""
    given = {f.name: F.col(f.name) for f in SCHEMA if f.name in df.columns} | ({"date_courrier": F.col("date")} if "date" in df.columns else {})
    given |= {"status": F.lit("pending"), "created_at": F.current_timestamp(), "validated_by": F.lit(None), "updated_at": F.lit(None)}
    return df.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA))


def insert(df: DataFrame, path: str) -> None:
    """Appends new rows, pending, to the table at ``path``."""
    pending(df).write.mode("append").parquet(path)


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def status_counts(df: DataFrame) -> DataFrame:
    """One pass; ``rejected`` is what is neither validated nor pending."""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "validated").alias("validated"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )
    return counts.withColumn("rejected", F.col("total") - F.col("validated") - F.col("pending"))


def confidence_mean(df: DataFrame) -> DataFrame:
    """Mean over rows of each row's mean; rows with a null or empty map are left out; 0 without any."""
    values = F.map_values("confidence")
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    exact = F.coalesce(F.avg(mean), F.lit(0.0))
    return df.agg(exact.alias("mean"), F.bround(exact, 1).alias("mean_rounded"))


def processing_time(df: DataFrame) -> DataFrame:
    exact = F.coalesce(F.avg("processing_time_ms"), F.lit(0.0))
    return df.agg(exact.alias("mean_ms"), F.bround(exact, 0).cast("long").alias("mean_ms_rounded"))


def overview(df: DataFrame) -> DataFrame:
    """Counts, mean confidence and mean time in one aggregation, both means also rounded half to even."""
    values = F.map_values("confidence")
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    out = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "validated").alias("validated"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.coalesce(F.avg(mean), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("time_ms"),
    )
    rounded = {"confidence_rounded": F.bround("confidence", 1), "time_ms_rounded": F.bround("time_ms", 0).cast("long")}
    return out.withColumns({"rejected": F.col("total") - F.col("validated") - F.col("pending"), **rounded})


def as_json(df: DataFrame) -> DataFrame:
    """id and the row's public form: date_courrier as ``date``, a null map as {}."""
    public = [c for c in df.columns if c not in ("file_path", "validated_by", "updated_at", "date_courrier", "confidence")]
    no_map = F.create_map().cast("map<string,int>")
    parts = [*(F.col(c) for c in public), F.col("date_courrier").alias("date"), F.coalesce("confidence", no_map).alias("confidence")]
    return df.select("id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def with_column_if_missing(df: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def one_row_per_content(df: DataFrame, content: str = "content") -> DataFrame:
    """The row with the least id of each content, by SHA-256, with the number of copies."""
    hashed = df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return hashed.groupBy("sha256").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


