"""Records that are written back, and search by index, over tables made from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.operators import search_index
from missiva.operators.record_table import RecordTable
from missiva.operators.scan_fields import FIELDS
from missiva.plans.catalogue import _SCAN_READ, query
from missiva.plans.measures import Stages, measured_scan
from missiva.sources.cache import RecognitionCache
from missiva.sources.letters import COURRIERS_CTE, LETTERS_CTE, courriers, letters
from missiva.sources.shared import scratch

PATCHED = "map<string,string>"


@query(
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'validated' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN NULL ELSE objet END AS objet, filename FROM courriers WHERE id % 11 <> 0",
    COURRIERS_CTE,
)
def table_written_back(spark, sf_dir):
    """Six sevenths of the rows to begin with; all rows inserted twice over; two patches for each third row; each eleventh row deleted."""
    given = courriers(spark, sf_dir)
    table = RecordTable(spark, scratch(spark, "records"), buckets=8)
    table.create(given.filter("id % 7 <> 0"))
    for _ in range(2):
        table.insert(given)
    ids = given.filter("id % 3 = 0").select("id")
    first = ids.select("id", F.lit(1).alias("seq"), F.create_map(F.lit("status"), F.lit("rejected")).cast(PATCHED).alias("fields"))
    both = F.create_map(F.lit("status"), F.lit("validated"), F.lit("objet"), F.lit(None).cast("string"))
    second = ids.select("id", F.lit(2).alias("seq"), F.when(F.col("id") % 6 == 0, both).otherwise(F.create_map(F.lit("status"), F.lit("validated"))).cast(PATCHED).alias("fields"))
    table.update(first.unionByName(second).withColumn("at", F.lit("2024-02-01").cast("timestamp")))
    table.delete(given.filter("id % 11 = 0").select("id"))
    return table.rows().select("id", "status", "objet", "filename")


def _indexed(name: str, field: str, term: str, where: str) -> None:
    def run(spark, sf_dir):
        df, path = courriers(spark, sf_dir), scratch(spark, "index")
        search_index.build(df, path)
        return search_index.search(df, path, term, field).select("id", "created_at")

    run.__name__ = name
    query(f"SELECT id, created_at FROM courriers WHERE {where} ORDER BY created_at DESC, id DESC LIMIT 50", COURRIERS_CTE)(run)


_indexed("indexed_search_objet", "objet", "TION", "objet ILIKE '%TION%'")
_indexed("indexed_search_contenu", "contenu", "lic_nse%under", "texte_complet ILIKE '%lic_nse%under%' OR corps ILIKE '%lic_nse%under%'")
_indexed(
    "indexed_search_all",
    "all",
    "src7",
    "objet ILIKE '%src7%' OR numero ILIKE '%src7%' OR expediteur ILIKE '%src7%' OR destinataire ILIKE '%src7%' OR texte_complet ILIKE '%src7%' OR corps ILIKE '%src7%'",
)


@query(
    _SCAN_READ
    + """SELECT 0 AS place, 'text' AS stage, count(*) AS rows, CAST(sum(length(texte_complet)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS fields FROM letters
UNION ALL SELECT 1, 'corrected', count(*), CAST(sum(length(texte_complet)) AS BIGINT), 0 FROM letters
UNION ALL SELECT 2, 'fields', count(*), CAST(sum(length(corps)) AS BIGINT), CAST(sum(7 - CASE WHEN etablissement IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM f""",
    LETTERS_CTE,
)
def stage_measures(spark, sf_dir):
    """Rows, characters and fields found at each stage of the scan profile, over all letters."""
    stages = Stages()
    measured_scan(letters(spark, sf_dir), stages).select("id", *FIELDS, "corps").write.format("noop").mode("overwrite").save()
    return stages.table(spark)


@query(
    """WITH p AS (SELECT page_id, html, strlen(html) AS n FROM pages),
seen AS (SELECT sha256(html) AS sha256, min(CASE WHEN page_id % 3 = 0 THEN 'first' ELSE 'second' END) AS batch FROM p GROUP BY 1)
SELECT page_id, s.sha256, substr(html, 1, 40) AS text, (n % 100) / CAST(100 AS DOUBLE) AS confidence, batch FROM p JOIN seen s ON s.sha256 = sha256(html)"""
)
def recognition_cache(spark, sf_dir):
    """A third of the pages, then all of them, then all again: each content is recognised by the first run that meets it."""

    def reading(data: bytes) -> tuple[str, float]:
        """Stands for an engine: the first letters, and a confidence from the length."""
        return data[:40].decode("utf-8", "ignore"), len(data) % 100 / 100

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").cast("binary").alias("content"), F.lit(None).cast("string").alias("refused"))
    cache = RecognitionCache(spark, scratch(spark, "cache"))
    cache.recognised(pages.filter("page_id % 3 = 0"), reading, "stub", "first")
    cache.recognised(pages, reading, "stub", "second")
    return cache.recognised(pages, reading, "stub", "third").select("page_id", "sha256", "text", "confidence", "batch")
