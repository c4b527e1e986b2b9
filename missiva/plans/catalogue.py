"""The mail engine's registered queries, each with SQL of its own making where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions import language, normalise
from missiva.operators import ocr, records, scan_fields, scoring, text_fields
from missiva.plans import cases
from missiva.plans.profiles import scan_fields_scored, scan_profile, text_fields_scored, text_profile
from missiva.sources import files
from missiva.sources.letters import CONFIDENCE_KEYS, COURRIERS_CTE, LETTERS_CTE, courriers, letters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: str | None = None):
    """Registers a query under its function's name, and its SQL after the common table expression ``base``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {base} {sql}" if base else sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- records -------------------------------------------------------------------------------------------------------


@query("SELECT id, status, processing_time_ms FROM courriers WHERE status = 'validated'", COURRIERS_CTE)
def status_filter(spark, sf_dir):
    return records.with_status(courriers(spark, sf_dir), "validated").select("id", "status", "processing_time_ms")


@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'pending') AS pending,"
    " count(*) - count(*) FILTER (WHERE status = 'validated') - count(*) FILTER (WHERE status = 'pending') AS rejected FROM courriers",
    COURRIERS_CTE,
)
def status_counts(spark, sf_dir):
    return records.status_counts(courriers(spark, sf_dir))


@query("SELECT round(coalesce(avg(row_mean), 0), 9) AS mean, round_even(coalesce(avg(row_mean), 0), 1) AS mean_rounded FROM courriers", COURRIERS_CTE)
def confidence_mean(spark, sf_dir):
    return records.confidence_mean(courriers(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query("SELECT coalesce(avg(processing_time_ms), 0) AS mean_ms, CAST(round_even(coalesce(avg(processing_time_ms), 0), 0) AS BIGINT) AS mean_ms_rounded FROM courriers", COURRIERS_CTE)
def processing_time_avg(spark, sf_dir):
    return records.processing_time(courriers(spark, sf_dir))


@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'pending') AS pending,"
    " count(*) FILTER (WHERE status = 'rejected') AS rejected, round(coalesce(avg(row_mean), 0), 9) AS confidence, round_even(coalesce(avg(row_mean), 0), 1) AS confidence_rounded,"
    " coalesce(avg(processing_time_ms), 0) AS time_ms, CAST(round_even(coalesce(avg(processing_time_ms), 0), 0) AS BIGINT) AS time_ms_rounded FROM courriers",
    COURRIERS_CTE,
)
def overview(spark, sf_dir):
    return records.overview(courriers(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query("SELECT id, filename, objet, 'pending' AS status, CAST(NULL AS VARCHAR) AS validated_by, CAST(NULL AS VARCHAR) AS langue_detectee, processing_time_ms FROM courriers", COURRIERS_CTE)
def insert_pending(spark, sf_dir):
    """The rows as records.insert appends them (their time of creation is the time of the insert, so it is left out)."""
    return records.pending(courriers(spark, sf_dir)).select("id", "filename", "objet", "status", "validated_by", "langue_detectee", "processing_time_ms")


@query("SELECT id, created_at FROM courriers ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20", COURRIERS_CTE)
def page_newest(spark, sf_dir):
    return records.page(courriers(spark, sf_dir).select("id", "created_at"), 2, 20)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM courriers WHERE status = 'pending'", COURRIERS_CTE)
def page_counts(spark, sf_dir):
    return records.page_counts(courriers(spark, sf_dir), 20, "pending")


def _search(field: str, term: str, where: str):
    def run(spark, sf_dir):
        return records.search(courriers(spark, sf_dir), term, field).select("id", "created_at")

    run.__name__ = f"search_{field}"
    return query(f"SELECT id, created_at FROM courriers WHERE {where} ORDER BY created_at DESC, id DESC LIMIT 50", COURRIERS_CTE)(run)


_search("objet", "TION", "objet ILIKE '%TION%'")
_search("contenu", "license", "texte_complet ILIKE '%license%' OR corps ILIKE '%license%'")
_search("expediteur", "SRC1", "expediteur ILIKE '%SRC1%'")
_search("destinataire", "f_", "destinataire ILIKE '%f_%'")
_search(
    "all",
    "src7",
    "objet ILIKE '%src7%' OR numero ILIKE '%src7%' OR expediteur ILIKE '%src7%' OR destinataire ILIKE '%src7%' OR texte_complet ILIKE '%src7%' OR corps ILIKE '%src7%'",
)


@query("SELECT id, filename, objet FROM courriers WHERE id = 42", COURRIERS_CTE)
def point_lookup(spark, sf_dir):
    return records.lookup(courriers(spark, sf_dir).select("id", "filename", "objet"), 42)


@query(
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'validated' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN NULL ELSE objet END AS objet FROM courriers",
    COURRIERS_CTE,
)
def partial_update(spark, sf_dir):
    """Two patches for each third row: the first is overwritten; each sixth row's objet becomes null."""
    table = courriers(spark, sf_dir).select("id", "status", "objet")
    none = F.lit(None).cast("string")
    plain, with_null = F.create_map(F.lit("status"), F.lit("validated")), F.create_map(F.lit("status"), F.lit("validated"), F.lit("objet"), none)
    ids = table.filter("id % 3 = 0").select("id")
    first = ids.select("id", F.lit(1).alias("seq"), F.create_map(F.lit("status"), F.lit("rejected")).alias("fields"))
    second = ids.select("id", F.lit(2).alias("seq"), F.when(F.col("id") % 6 == 0, with_null).otherwise(plain).alias("fields"))
    return records.update(table, first.unionByName(second).withColumn("at", F.lit("2024-02-01").cast("timestamp")))


@query("SELECT id, status FROM courriers WHERE id % 7 <> 0", COURRIERS_CTE)
def delete_rows(spark, sf_dir):
    table = courriers(spark, sf_dir).select("id", "status")
    return records.delete(table, table.filter("id % 7 = 0"))


_MAP_JSON = ", ',', ".join(f"'\"{name}\":', (id * {k + 3}) % 101" for k, name in enumerate(CONFIDENCE_KEYS))
_JSON_SQL = (
    f"SELECT id, concat('{{\"id\":', id, ',\"status\":\"', status, '\",\"date\":null,\"confidence\":{{', CASE WHEN id % 10 >= 2 THEN concat({_MAP_JSON}) ELSE '' END, '}}}}') AS json"
    " FROM courriers"
)


@query(_JSON_SQL, COURRIERS_CTE)
def json_row(spark, sf_dir):
    return records.as_json(courriers(spark, sf_dir).select("id", "status", "date_courrier", "confidence"))


@query(_JSON_SQL, COURRIERS_CTE)
def json_all_rows(spark, sf_dir):
    return json_row(spark, sf_dir)


@query("SELECT id, CAST(NULL AS VARCHAR) AS etablissement FROM courriers", COURRIERS_CTE)
def add_missing_column(spark, sf_dir):
    return records.with_column_if_missing(courriers(spark, sf_dir).select("id"), "etablissement")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return records.one_row_per_content(_documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), "text")


# --- files ---------------------------------------------------------------------------------------------------------

_NAME = "concat('in/', page_id, CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.docx' ELSE '' END)"


@query(
    f"""SELECT page_id, ext, CASE WHEN ext = '.pdf' THEN 'pdf' ELSE 'image' END AS file_type,
    CASE WHEN ext NOT IN ('.pdf', '.jpg', '.jpeg', '.png') THEN 'extension' WHEN length > 20971520 THEN 'size' END AS refused
    FROM (SELECT page_id, lower(regexp_extract({_NAME}, '(\\.[^./]+)$', 1)) AS ext, strlen(html) * 2000 AS length FROM pages)"""
)
def ext_allow_list(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.select("page_id", F.expr(_NAME).alias("path"), (F.octet_length("html").cast("long") * 2000).alias("length"))
    return files.accepted(listed).select("page_id", "ext", "file_type", "refused")


@query(f"SELECT page_id, sha256(html) AS sha256, concat(sha256(html), lower(regexp_extract({_NAME}, '(\\.[^./]+)$', 1))) AS stored_as FROM pages")
def stored_files(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(_NAME).alias("path"), F.col("html").cast("binary").alias("content"))
    return files.stored(pages).select("page_id", "sha256", "stored_as")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10")
def text_ingestion(spark, sf_dir):
    return files.text_rows(_documents(spark, sf_dir)).select("doc_id")


# --- text repair ---------------------------------------------------------------------------------------------------

_NOISY = (
    "SELECT o_orderkey AS id, concat('Réf ‘', o_custkey, '’ – “', o_orderpriority, '”', chr(10), '----', chr(10), 'CADI AWAYAD  le  0 2 AVR.  ',"
    " CASE WHEN o_orderkey % 3 = 0 THEN '2076' ELSE '7026' END, '   N'' ', o_custkey, chr(10), translate(CAST(o_orderkey AS {s}), '0123456789', '٠١٢٣٤٥٦٧٨٩'),"
    " ' مـــحـمَّد،الرئاسه ', chr(10), chr(10), chr(10), chr(10), chr(10), 'fin') AS t FROM {orders}"
)
_NOISY_CTE = "noisy AS (" + _NOISY.replace("{s}", "VARCHAR").replace("{orders}", "orders") + ")"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NOISY.replace("{s}", "STRING"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _repair(name: str, column: Callable[[Column], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return _noisy(spark, sf_dir).select("id", column(F.col("t")).alias("t"))

    run.__name__ = name
    query(f"SELECT id, {sql} AS t FROM noisy", _NOISY_CTE)(run)


_repair("quotes_dashes", normalise.quotes_dashes, r"""regexp_replace(replace(replace(replace(replace(t, '’', chr(39)), '‘', chr(39)), '“', '"'), '”', '"'), '[‐-―−]', '-', 'g')""")
_repair("arabic_digits", normalise.digits, "translate(translate(t, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '۰۱۲۳۴۵۶۷۸۹', '0123456789')")
_repair(
    "unflatten_lines",
    normalise.unflatten,
    "CASE WHEN len(regexp_extract_all(t, '  +')) >= 3 AND len(regexp_extract_all(t, '  +')) > length(t) - length(replace(t, chr(10), '')) THEN regexp_replace(t, ' {2,}', chr(10), 'g') ELSE t END",
)
_repair("collapse_space", normalise.spaces, r"regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')")
_repair("year_repair", normalise.years, r"regexp_replace(regexp_replace(t, '\b20[6-9]6\b', '2026', 'g'), '\b[6-9]026\b', '2026', 'g')")
_repair(
    "harakat_tatweel",
    normalise.marks,
    r"regexp_replace(regexp_replace(regexp_replace(t, 'ـ+', '', 'g'), '[\x{064B}-\x{0670}\x{065F}]', '', 'g'), '\s*،\s*', '، ', 'g')",
)
_repair("noise_lines", normalise.noise_lines, r"regexp_replace(regexp_replace(t, '\n----\n', chr(10) || chr(10), 'g'), '\n{5}', chr(10) || chr(10), 'g')")
_repair("stamp_days", normalise.stamp_days, r"regexp_replace(t, '\b(\d)[ ]+(\d)[ ]+(AVR)', '\1\2 \3', 'g')")


_PREFIX = "r@K@x "


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.drawn(spark, sf_dir, [_PREFIX + t for t, _, _ in cases.REPAIRS])


@query(cases.drawn_sql(t=[_PREFIX + t for _, t, _ in cases.REPAIRS]))
def normalise_text_profile(spark, sf_dir):
    return _repairs(spark, sf_dir).select("id", normalise.normalise_text(F.col("text")).alias("t"))


@query(cases.drawn_sql(t=[_PREFIX + t for _, _, t in cases.REPAIRS]))
def normalise_scan_profile(spark, sf_dir):
    return _repairs(spark, sf_dir).select("id", normalise.normalise_scan(F.col("text")).alias("t"))


# --- language ------------------------------------------------------------------------------------------------------

_COUNTS = (
    ", n AS (SELECT id, len(regexp_extract_all(texte_complet, '[\\x{0600}-\\x{06FF}]')) AS a, len(regexp_extract_all(texte_complet, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]')) AS w,"
    " len(regexp_extract_all(texte_complet, '[A-Za-zÀ-ÿ]')) AS l FROM letters) "
)


@query(
    _COUNTS + "SELECT id, CASE WHEN a + l < 10 THEN 'unknown' WHEN a / (a + l) > 0.7 THEN 'ar' WHEN a / (a + l) < 0.2 THEN 'fr' ELSE 'fr+ar' END AS scan,"
    " CASE WHEN w > l THEN 'ar' WHEN w > 0 AND w > l * 0.2 THEN 'fr+ar' ELSE 'fr' END AS text,"
    " CASE WHEN a + l < 20 OR a / (a + l) < 0.15 THEN 'tesseract' WHEN a / (a + l) > 0.6 THEN 'easyocr' ELSE 'hybrid' END AS mode,"
    " CASE WHEN w / (w + l) > 0.6 THEN 'ar' WHEN w / (w + l) > 0.15 THEN 'fr+ar' ELSE 'fr' END AS zones, w / (w + l) > 0.2 AS specialist FROM n",
    LETTERS_CTE,
)
def languages(spark, sf_dir):
    t = F.col("texte_complet")
    zones = language.language_zones(t)
    return letters(spark, sf_dir).select(
        "id",
        language.language_scan(t).alias("scan"),
        language.language_text(t).alias("text"),
        language.ocr_mode(t).alias("mode"),
        zones["language"].alias("zones"),
        zones["specialist"].alias("specialist"),
    )


# --- zones and fields ----------------------------------------------------------------------------------------------


@query(
    ", z AS (SELECT id, texte_complet AS t, strpos(texte_complet, chr(10) || 'A' || chr(10) || 'Monsieur') - 1 AS p FROM letters)"
    " SELECT id, substr(t, 1, greatest(800, least(p + 200, 3000))) AS header, substr(t, 1, p) AS sender FROM z",
    LETTERS_CTE,
)
def header_sender_zones(spark, sf_dir):
    t = F.col("texte_complet")
    return letters(spark, sf_dir).select("id", scan_fields.header(t).alias("header"), scan_fields.sender_zone(t).alias("sender"))


@query(
    "SELECT id, CASE WHEN texte_complet LIKE '%Bordereau d''envoi%' THEN 'bordereau' WHEN texte_complet LIKE '%Note de service%' THEN 'note' ELSE 'lettre' END AS type_document FROM letters",
    LETTERS_CTE,
)
def doc_type_scan(spark, sf_dir):
    return letters(spark, sf_dir).select("id", scan_fields.type_document(F.col("texte_complet")).alias("type_document"))


@query(
    "SELECT id, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 3 = 0 THEN 'FSS-Marrakech' WHEN id % 3 = 1 THEN 'FST-Marrakech' ELSE 'La Présidence - Marrakech' END AS etablissement FROM letters",
    LETTERS_CTE,
)
def etablissement_scan(spark, sf_dir):
    zone = scan_fields.sender_zone(F.col("texte_complet"))
    return letters(spark, sf_dir).select("id", scan_fields.etablissement(zone).alias("etablissement"))


@query(
    "SELECT id, CASE WHEN id % 4 = 3 THEN concat(id % 900 + 100, '/', id % 8000 + 1000) WHEN id % 2 = 0 THEN concat(id % 900 + 100, '/', id % 8000 + 1000) ELSE CAST(id % 900 + 100 AS VARCHAR) END AS numero FROM letters",
    LETTERS_CTE,
)
def numero_scan(spark, sf_dir):
    fixed = normalise.digits(F.col("texte_complet"))
    out = letters(spark, sf_dir).withColumn("t", fixed)
    return out.select("id", scan_fields.numero(F.col("t"), scan_fields.header(F.col("t"))).alias("numero"))


@query(r"SELECT id, regexp_extract(texte_complet, 'le (\d\d [^ ]+ \d{4})', 1) AS date FROM letters", LETTERS_CTE)
def date_scan(spark, sf_dir):
    return letters(spark, sf_dir).select("id", scan_fields.date_in(scan_fields.header(F.col("texte_complet"))).alias("date"))


@query(
    "SELECT o_orderkey AS id, CASE WHEN year(o_orderdate) + 25 BETWEEN 2020 AND 2030 THEN concat(CASE WHEN o_orderkey % 9 = 0 THEN '45' ELSE strftime(o_orderdate, '%d') END, ' ',"
    " ['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'][month(o_orderdate)], ' ', year(o_orderdate) + 25) END AS date FROM orders"
)
def date_numeric(spark, sf_dir):
    d = F.col("o_orderdate")
    day = F.when(F.col("o_orderkey") % 9 == 0, "45").otherwise(F.date_format(d, "dd"))
    t = F.concat(F.lit("Reçu le "), day, F.date_format(d, "/MM/"), (F.year(d) + 25).cast("string"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), scan_fields.date_in(t).alias("date"))


@query(r"SELECT id, regexp_extract(texte_complet, 'Objet : ([^\n]+)', 1) AS objet FROM letters", LETTERS_CTE)
def objet_scan(spark, sf_dir):
    return letters(spark, sf_dir).select("id", scan_fields.objet(F.col("texte_complet")).alias("objet"))


@query(
    "SELECT id, CASE WHEN id % 4 = 3 THEN 'Le Doyen — Présidence UCA' WHEN id % 3 = 0 THEN 'Le Doyen — FSS Semlalia' WHEN id % 3 = 1 THEN 'Le Doyen — FST Marrakech' ELSE 'Le Doyen' END AS expediteur,"
    " 'Monsieur le Président de l''Université' AS destinataire FROM letters",
    LETTERS_CTE,
)
def sender_recipient_scan(spark, sf_dir):
    t, zone = F.col("texte_complet"), F.col("zone")
    zoned = letters(spark, sf_dir).withColumn("zone", scan_fields.sender_zone(t))
    return zoned.select("id", scan_fields.expediteur(t, zone, scan_fields.etablissement(zone)).alias("expediteur"), scan_fields.destinataire(t).alias("destinataire"))


@query(
    r"SELECT id, substr(texte_complet, strpos(texte_complet, 'Monsieur le Président,'), strpos(texte_complet, chr(10) || 'Veuillez') - strpos(texte_complet, 'Monsieur le Président,')) AS corps FROM letters",
    LETTERS_CTE,
)
def corps_scan(spark, sf_dir):
    return letters(spark, sf_dir).select("id", scan_fields.corps(F.col("texte_complet")).alias("corps"))


# --- profile, scores, routes ---------------------------------------------------------------------------------------


#: What the scan profile reads in the plain letters, by their template.
_SCAN_READ = (
    _COUNTS.rstrip() + r""", f AS (
  SELECT id, CASE WHEN id % 4 = 3 OR id % 2 = 0 THEN concat(id % 900 + 100, '/', id % 8000 + 1000) ELSE CAST(id % 900 + 100 AS VARCHAR) END AS numero,
    regexp_extract(texte_complet, 'le (\d\d [^ ]+ \d{4})', 1) AS date, regexp_extract(texte_complet, 'Objet : ([^\n]+)', 1) AS objet,
    CASE WHEN id % 4 = 3 THEN 'Le Doyen — Présidence UCA' WHEN id % 3 = 0 THEN 'Le Doyen — FSS Semlalia' WHEN id % 3 = 1 THEN 'Le Doyen — FST Marrakech' ELSE 'Le Doyen' END AS expediteur,
    'Monsieur le Président de l''Université' AS destinataire,
    CASE WHEN texte_complet LIKE '%Bordereau d''envoi%' THEN 'bordereau' WHEN texte_complet LIKE '%Note de service%' THEN 'note' ELSE 'lettre' END AS type_document,
    CASE WHEN id % 4 = 3 THEN NULL WHEN id % 3 = 0 THEN 'FSS-Marrakech' WHEN id % 3 = 1 THEN 'FST-Marrakech' ELSE 'La Présidence - Marrakech' END AS etablissement,
    substr(texte_complet, strpos(texte_complet, 'Monsieur le Président,'), strpos(texte_complet, chr(10) || 'Veuillez') - strpos(texte_complet, 'Monsieur le Président,')) AS corps,
    CASE WHEN a + l < 10 THEN 'unknown' WHEN a / (a + l) > 0.7 THEN 'ar' WHEN a / (a + l) < 0.2 THEN 'fr' ELSE 'fr+ar' END AS langue_detectee, false AS has_stamp
  FROM letters JOIN n USING (id)) """
)
_FIELDS_LONG = """(SELECT *, unnest(['numero', 'date', 'objet', 'expediteur', 'destinataire', 'type_document', 'etablissement']) AS field,
    unnest([numero, date, objet, expediteur, destinataire, type_document, etablissement]) AS value FROM f)"""
#: Scores of the scan profile and their routes, from (id, field, value, has_stamp).
_SCAN_SCORES = """, s AS (
  SELECT id, field, value, CASE WHEN value IS NULL THEN 0 WHEN field = 'type_document' THEN CASE WHEN value = 'lettre' THEN 0.55e0 ELSE 0.85e0 END
      ELSE CASE field WHEN 'numero' THEN CASE WHEN has_stamp THEN 0.90e0 ELSE 0.70e0 END WHEN 'date' THEN CASE WHEN has_stamp THEN 0.95e0 ELSE 0.85e0 END
          WHEN 'objet' THEN 0.80e0 WHEN 'etablissement' THEN 0.90e0 ELSE 0.85e0 END
        - CASE WHEN length(value) < 5 THEN 0.15e0 ELSE 0 END - CASE WHEN length(value) > 200 THEN 0.05e0 ELSE 0 END END AS score
  FROM """ + _FIELDS_LONG + """)
SELECT id, field, value, round(CAST(score AS DOUBLE), 6) AS score, CAST(floor(CAST(score AS DOUBLE) * 100) AS INTEGER) AS percent,
  CASE WHEN score < 0.60e0 THEN 'manual' WHEN score < 0.90e0 THEN 'review' ELSE 'auto' END AS action,
  CASE WHEN score < 0.60e0 THEN 'red' WHEN score < 0.90e0 THEN 'yellow' ELSE 'green' END AS color,
  CASE WHEN score >= 0.60e0 THEN value END AS shown FROM s"""


@query(_SCAN_READ + "SELECT * FROM f", LETTERS_CTE)
def scan_profile_fields(spark, sf_dir):
    return scan_profile(letters(spark, sf_dir)).select("id", *scan_fields.FIELDS, "corps", "langue_detectee", "has_stamp")


@query(_SCAN_READ + _SCAN_SCORES, LETTERS_CTE)
def score_route_scan(spark, sf_dir):
    return scan_fields_scored(letters(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(cases.read_sql(cases.SCAN))
def mail_scan_fields(spark, sf_dir):
    """Stamps, ten types, bodies, noise: letters with stated results."""
    return scan_profile(cases.letters(spark, sf_dir)).select("id", *scan_fields.FIELDS, "corps", F.col("langue_detectee").alias("langue"))


_STAMPED = f"o_orderkey % {len(cases.LETTERS)} IN {cases.STAMPED} AS has_stamp FROM orders"


@query("WITH f AS (" + cases.read_sql(cases.SCAN).replace("FROM orders", ", " + _STAMPED) + ")" + _SCAN_SCORES)
def mail_scan_scores(spark, sf_dir):
    return scan_fields_scored(cases.letters(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(cases.read_sql(cases.TEXT))
def mail_text_fields(spark, sf_dir):
    return text_profile(cases.letters(spark, sf_dir)).select("id", *scan_fields.FIELDS, "corps", F.col("langue_detectee").alias("langue"))


#: Scores of the text profile, from (id, field, value).
_TEXT_SCORES = r""", s AS (
  SELECT id, field, value, CASE WHEN value IS NULL OR value = '' THEN 0.0
      WHEN field = 'numero' THEN CASE WHEN regexp_matches(value, '^[0-9]{2,6}/[0-9]{2,4}(/[A-Z-]+)?$') THEN 0.90 WHEN regexp_matches(value, '^[0-9]{3,5}$') THEN 0.70 ELSE 0.55 END
      WHEN field = 'date' THEN CASE WHEN regexp_matches(value, '^[0-9]{2} [^ ]+ [0-9]{4}$') THEN 0.95 ELSE 0.55 END
      WHEN field = 'objet' THEN CASE WHEN length(value) BETWEEN 10 AND 200 THEN 0.80 WHEN length(value) > 200 THEN 0.60 ELSE 0.55 END
      WHEN field = 'expediteur' THEN CASE CAST(regexp_matches(value, 'Pr[eé]sident|Doyen|Directeur|Vice|Secr[eé]taire|رئيس|العميد|المدير') AS INTEGER)
          + CAST(regexp_matches(value, 'Facult[eé]|Universit[eé]|CRI|EST|FST|FSJES|FSS|FMP|FLSH|ENSA|ENCG|Pr[eé]sidence|كلية|جامعة|المدرسة') AS INTEGER) WHEN 2 THEN 0.90 WHEN 1 THEN 0.70 ELSE 0.55 END
      WHEN field = 'destinataire' THEN CASE WHEN regexp_matches(value, 'Pr[eé]sident|Doyen|Directeur|Universit[eé]|Facult[eé]|رئيس|جامعة|كلية') THEN 0.85 ELSE 0.60 END
      WHEN field = 'type_document' THEN CASE WHEN value <> 'lettre' THEN 0.85 ELSE 0.55 END
      ELSE CASE WHEN value IN ('FSJES-Marrakech', 'FSS-Marrakech', 'FST-Marrakech', 'EST-Essaouira', 'EST-Safi', 'FP-Safi', 'CRI-Marrakech-Safi', 'La Présidence - Marrakech', 'FMP-Marrakech',
          'FLSH-Marrakech', 'ENSA-Marrakech', 'ENCG-Marrakech') THEN 0.90 ELSE 0.55 END END AS score
  FROM """ + _FIELDS_LONG + """)
SELECT id, field, value, CAST(score AS DOUBLE) AS score, CAST(floor(CAST(score AS DOUBLE) * 100 + 1e-9) AS INTEGER) AS percent FROM s"""


@query("WITH f AS (" + cases.read_sql(cases.TEXT) + ")" + _TEXT_SCORES)
def mail_text_scores(spark, sf_dir):
    return text_fields_scored(cases.letters(spark, sf_dir))


@query(
    """, f AS (
  SELECT id, unnest(['numero', 'date', 'objet', 'expediteur', 'destinataire', 'type_document', 'etablissement']) AS field,
    unnest([0.70 - CASE WHEN id % 4 <> 3 AND id % 2 = 1 THEN 0.15 ELSE 0 END, 0.85, 0.80, 0.85, 0.85, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 0.85 ELSE 0.55 END,
      CASE WHEN id % 4 = 3 THEN 0.0 ELSE 0.90 END]) AS score FROM letters)
SELECT field, CASE WHEN score < 0.60 THEN 'manual' WHEN score < 0.90 THEN 'review' ELSE 'auto' END AS action, count(*) AS n FROM f GROUP BY ALL""",
    LETTERS_CTE,
)
def review_queue(spark, sf_dir):
    return scoring.review_queue(scan_fields_scored(letters(spark, sf_dir)))


_TEXT_READ = (
    ", n AS (SELECT *, len(regexp_extract_all(texte_complet, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]')) AS w, len(regexp_extract_all(texte_complet, '[A-Za-zÀ-ÿ]')) AS l FROM letters)"
    " SELECT id, CASE WHEN id % 4 = 3 OR id % 2 = 0 THEN concat(id % 900 + 100, '/', regexp_replace(CAST(id % 8000 + 1000 AS VARCHAR), '^(?:20[6-9]6|[6-9]026)$', '2026'))"
    " ELSE CAST(id % 900 + 100 AS VARCHAR) END AS numero,"
    r" regexp_extract(texte_complet, 'le (\d\d [^ ]+ \d{4})', 1) AS date, regexp_extract(texte_complet, 'Objet : ([^\n]+)', 1) AS objet,"
    " CASE WHEN texte_complet LIKE '%Bordereau d''envoi%' THEN 'bordereau' WHEN texte_complet LIKE '%Note de service%' THEN 'note' ELSE 'lettre' END AS type_document,"
    " CASE WHEN id % 4 = 3 THEN 'La Présidence - Marrakech' WHEN id % 3 = 0 THEN 'FSS-Marrakech' WHEN id % 3 = 1 THEN 'FST-Marrakech' ELSE 'La Présidence - Marrakech' END AS etablissement,"
    " CASE WHEN w > l THEN 'ar' WHEN w > 0 AND w > l * 0.2 THEN 'fr+ar' ELSE 'fr' END AS langue FROM n"
)


@query(_TEXT_READ, LETTERS_CTE)
def text_profile_fields(spark, sf_dir):
    out = text_profile(letters(spark, sf_dir))
    return out.select("id", "numero", "date", "objet", "type_document", "etablissement", F.col("langue_detectee").alias("langue"))


@query(_TEXT_READ, LETTERS_CTE)
def text_profile_all_letters(spark, sf_dir):
    return text_profile_fields(spark, sf_dir)


_READ_CTE, _READ_SELECT = _TEXT_READ.split(" SELECT id, ", 1)
#: The plain letters' fields and bodies in the text profile, as the common table expression f.
_TEXT_FIELDS = (
    _READ_CTE
    + ", r AS (SELECT id, "
    + _READ_SELECT
    + r"""), f AS (SELECT r.*,
    CASE WHEN id % 4 = 3 THEN 'Le Doyen — Présidence UCA' WHEN id % 3 = 0 THEN 'Le Doyen — FSS Semlalia' WHEN id % 3 = 1 THEN 'Le Doyen — FST Marrakech' ELSE 'Le Doyen' END AS expediteur,
    concat('Monsieur le Président de l''Université', CASE WHEN id % 5 <> 0 AND id % 7 = 0 THEN ' Note de service' ELSE '' END) AS destinataire,
    concat(CASE WHEN id % 5 = 0 THEN concat('Bordereau d''envoi', chr(10)) ELSE '' END, 'Objet : ', objet, chr(10), 'Monsieur le Président,', chr(10),
      regexp_extract(texte_complet, '(J''ai l''honneur [^\n]+)', 1)) AS corps
  FROM r JOIN letters USING (id))"""
)


@query(_TEXT_FIELDS + " SELECT id, expediteur, destinataire, corps FROM f", LETTERS_CTE)
def text_profile_bodies(spark, sf_dir):
    return text_profile(letters(spark, sf_dir)).select("id", "expediteur", "destinataire", "corps")


@query(_TEXT_FIELDS + _TEXT_SCORES, LETTERS_CTE)
def score_text(spark, sf_dir):
    return text_fields_scored(letters(spark, sf_dir))


@query(
    ", z AS (SELECT id, texte_complet AS t, strpos(texte_complet, chr(10) || 'A' || chr(10) || 'Monsieur') - 1 AS p FROM letters)"
    " SELECT id, substr(t, 1, greatest(800, least(p + 200, 3000))) AS header FROM z",
    LETTERS_CTE,
)
def header_zone_text(spark, sf_dir):
    return letters(spark, sf_dir).select("id", text_fields.text_header(F.col("texte_complet")).alias("header"))


# --- around OCR ----------------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS block_num, l_partkey % 2 AS par_num, l_suppkey % 3 AS line_num, l_partkey AS left_at, l_linenumber AS ord,
    CASE WHEN l_linenumber = 4 THEN ' ' ELSE concat('w', l_partkey) END AS text FROM lineitem),
  l AS (SELECT doc_id, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY left_at, ord, text) AS line FROM w WHERE trim(text) <> '' GROUP BY ALL)
SELECT doc_id, string_agg(line, chr(10) ORDER BY block_num, par_num, line_num) AS text FROM l GROUP BY doc_id"""
)
def line_reconstruct(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") % 2).alias("block_num"),
        (F.col("l_partkey") % 2).alias("par_num"),
        (F.col("l_suppkey") % 3).alias("line_num"),
        F.col("l_partkey").alias("left"),
        F.col("l_linenumber").alias("ord"),
        F.when(F.col("l_linenumber") == 4, " ").otherwise(F.concat(F.lit("w"), F.col("l_partkey"))).alias("text"),
    )
    return ocr.lines_of_words(words)


@query(
    """WITH d AS (SELECT event_id, user_id AS doc_id, CAST(event_id % 200 AS DOUBLE) AS y, CAST(event_id % 37 AS DOUBLE) AS x,
    CASE WHEN event_id % 4 = 0 THEN 'رقم' ELSE event_type END AS text FROM events),
  n AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, event_id) >= 20 THEN 1 ELSE 0 END AS step FROM d),
  l AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY y, event_id ROWS UNBOUNDED PRECEDING) AS line FROM n),
  a AS (SELECT *, max(CASE WHEN text = 'رقم' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line) AS ar FROM l)
SELECT doc_id, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY doc_id, line ORDER BY CASE WHEN ar = 1 THEN -x ELSE x END, event_id) AS place, text FROM a"""
)
def spatial_order(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("doc_id"),
        (F.col("event_id") % 200).cast("double").alias("y_mean"),
        (F.col("event_id") % 37).cast("double").alias("x_max"),
        F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 4 == 0, "رقم").otherwise(F.col("event_type")).alias("text"),
    )
    out = ocr.reading_order(found)
    return out.withColumns({"line": F.col("line").cast("long"), "place": F.col("place").cast("long")})


@query(
    """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_partkey % 2 = 0 THEN 'tesseract' ELSE 'easyocr' END AS engine,
    concat('page ', l_partkey) AS text, l_discount AS confidence FROM lineitem)
SELECT doc_id, string_agg(text, chr(10) || chr(10) || '--- Page suivante ---' || chr(10) || chr(10) ORDER BY page_no, text) AS text,
  array_to_string(list_sort(list_distinct(list(engine))), ',') AS engine, round(avg(confidence), 6) AS confidence,
  CASE WHEN count(*) * 4 + (count(*) - 1) * 12 < 10 THEN 'unknown' ELSE 'fr' END AS langue -- letters of "page" and of "Page suivante"
FROM p GROUP BY doc_id"""
)
def page_merge(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page_no"),
        F.when(F.col("l_partkey") % 2 == 0, "tesseract").otherwise("easyocr").alias("engine"),
        F.concat(F.lit("page "), F.col("l_partkey")).alias("text"),
        F.col("l_discount").alias("confidence"),
    )
    return ocr.merge_pages(pages).withColumn("confidence", F.round("confidence", 6))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 > (o_custkey % 50) * 1.3 OR (o_orderkey % 11) / 11.0 > (o_custkey % 13) / 13.0 THEN 'easyocr' ELSE 'tesseract' END AS live,
    CASE WHEN (o_custkey % 13) / CAST(13 AS DOUBLE) * CASE WHEN o_orderkey % 50 > 15 THEN 0.9 ELSE 1.1 END >= (o_orderkey % 11) / CAST(11 AS DOUBLE) * CASE WHEN o_orderkey % 50 > 15 THEN 1.3 ELSE 1.0 END
      THEN 'tesseract' ELSE 'specialist' END AS weighted FROM orders"""
)
def hybrid_choice(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    easy, tess = (F.col("o_orderkey") % 11) / 11, (F.col("o_custkey") % 13) / 13
    return orders.select(
        F.col("o_orderkey").alias("id"),
        ocr.hybrid(F.col("o_orderkey") % 50, F.col("o_custkey") % 50, easy, tess).alias("live"),
        ocr.hybrid_weighted((F.col("o_orderkey") % 50) / 50, easy, tess).alias("weighted"),
    )


@query(
    """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CAST(l_partkey % 4 AS INTEGER) AS psm,
    0.7 * l_discount * 10 + 0.3 * least(l_quantity * 20 / 500, 1.0) AS score FROM lineitem),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord, psm DESC) AS n FROM r)
SELECT doc_id, psm, round(score, 6) AS score FROM b WHERE n = 1"""
)
def psm_argmax(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("ord"),
        (F.col("l_partkey") % 4).cast("int").alias("psm"),
        (F.col("l_discount") * 10).alias("conf"),
        (F.col("l_quantity") * 20).alias("chars"),
    )
    return ocr.best_segmentation(runs).withColumn("score", F.round("score", 6))


@query(
    """WITH w AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS INTEGER) - 30 AS conf FROM lineitem)
SELECT doc_id, round(coalesce(avg(conf) FILTER (WHERE conf > 0) / 100, 0.5), 9) AS confidence FROM w GROUP BY doc_id"""
)
def word_confidence(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity").cast("int") - 30).alias("conf"))
    return ocr.word_confidence(words).withColumn("confidence", F.round("confidence", 9))


@query(
    """WITH v AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE concat('v', l_partkey) END AS text FROM lineitem)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord, text) AS text FROM v WHERE trim(text) <> '' GROUP BY doc_id"""
)
def variants_text(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("ord"),
        F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit("v"), F.col("l_partkey"))).alias("text"),
    )
    return ocr.variants_text(runs)


@query(
    """WITH p AS (SELECT o_orderkey AS id, ['auto', 'tesseract', 'easyocr', 'hybrid'][o_custkey % 4 + 1] AS requested,
    CASE o_orderkey % 3 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'easyocr' ELSE 'hybrid' END AS looked_for,
    o_orderkey % 2 = 0 AS t, o_orderkey % 5 > 1 AS e, o_orderkey % 7 > 2 AS h FROM orders),
  a AS (SELECT *, CASE WHEN requested = 'auto' THEN looked_for ELSE requested END AS asked FROM p),
  r AS (SELECT *, CASE WHEN asked = 'hybrid' AND h THEN 'hybrid' WHEN asked = 'easyocr' AND e THEN 'easyocr' WHEN t THEN 'tesseract' WHEN e THEN 'easyocr' ELSE 'failed' END AS engine FROM a)
SELECT id, asked, engine, CASE WHEN engine = 'failed' THEN '' ELSE concat(engine, ' ', id) END AS text FROM r"""
)
def engine_dispatch(spark, sf_dir):
    """The page's engine by request or by its text, and the chain after it, over results that some engines don't have."""
    key = F.col("o_orderkey")
    latin, arabic = "Une page en français, sans rien d'autre", "صفحة باللغة العربية وحدها بلا شيء آخر"
    quick = F.when(key % 3 == 0, latin).when(key % 3 == 1, arabic).otherwise(latin + arabic)
    requested = F.element_at(F.array(*map(F.lit, ("auto", "tesseract", "easyocr", "hybrid"))), (F.col("o_custkey") % 4 + 1).cast("int"))

    def result(engine: str, has_text: Column) -> Column:
        return F.struct(F.when(has_text, F.concat(F.lit(f"{engine} "), key)).otherwise(" ").alias("text"), F.lit(engine).alias("engine"))

    results = {"tesseract": result("tesseract", key % 2 == 0), "easyocr": result("easyocr", key % 5 > 1), "hybrid": result("hybrid", key % 7 > 2)}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), ocr.engine_asked(requested, quick).alias("asked"), *(r.alias(n) for n, r in results.items()))
    chosen = ocr.dispatched(F.col("asked"), {n: F.col(n) for n in results})
    return orders.select("id", "asked", chosen["engine"].alias("engine"), chosen["text"].alias("text"))


@query(cases.drawn_sql(text=[t for _, _, t in cases.ARABIC_REPAIRS]))
def arabic_fix(spark, sf_dir):
    share = F.get(F.array(*(F.lit(n / 10) for _, n, _ in cases.ARABIC_REPAIRS)), F.col("case"))
    return cases.drawn(spark, sf_dir, [t for t, _, _ in cases.ARABIC_REPAIRS]).select("id", ocr.arabic_fix(F.col("text"), share).alias("text"))


@query(cases.drawn_sql(numero=[n for _, n, _ in cases.STAMPS], date=[d for _, _, d in cases.STAMPS]))
def stamp_fields_text(spark, sf_dir):
    """Number and date of arrival stamps, found by each of the text profile's ways."""
    zone = F.col("zone")
    zoned = cases.drawn(spark, sf_dir, [t for t, _, _ in cases.STAMPS]).select("id", text_fields.stamp_zone(F.col("text")).alias("zone"))
    return zoned.select("id", text_fields.stamp_number(zone).alias("numero"), text_fields.stamp_date(zone).alias("date"))
