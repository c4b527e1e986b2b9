"""Letters and records made from the given tables by one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The template uses only what both dialects share. {orders} names the table.
LETTERS_SQL = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 4 = 3 THEN concat('جامعة القاضي عياض', chr(10), 'الرئاسة', chr(10),
         'رقم : ', translate(concat(lpad(CAST(o_orderkey % 900 + 100 AS STRING), 3, '0'), '/', CAST(o_orderkey % 8000 + 1000 AS STRING)), '0123456789', '٠١٢٣٤٥٦٧٨٩'), chr(10))
       WHEN o_orderkey % 3 = 0 THEN concat('Université Cadi Ayyad', chr(10), 'Faculté des Sciences Semlalia', chr(10),
         'N° ', CAST(o_orderkey % 900 + 100 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN concat('/', CAST(o_orderkey % 8000 + 1000 AS STRING)) ELSE '' END, chr(10))
       WHEN o_orderkey % 3 = 1 THEN concat('Université Cadi Ayyad', chr(10), 'Faculté des Sciences et Techniques', chr(10),
         'N° ', CAST(o_orderkey % 900 + 100 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN concat('/', CAST(o_orderkey % 8000 + 1000 AS STRING)) ELSE '' END, chr(10))
       ELSE concat('Université Cadi Ayyad', chr(10), 'La Présidence', chr(10),
         'N° ', CAST(o_orderkey % 900 + 100 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN concat('/', CAST(o_orderkey % 8000 + 1000 AS STRING)) ELSE '' END, chr(10)) END
  || concat('Marrakech, le ', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), ' ',
       CASE month(o_orderdate) WHEN 1 THEN 'janvier' WHEN 2 THEN 'février' WHEN 3 THEN 'mars' WHEN 4 THEN 'avril' WHEN 5 THEN 'mai' WHEN 6 THEN 'juin'
         WHEN 7 THEN 'juillet' WHEN 8 THEN 'août' WHEN 9 THEN 'septembre' WHEN 10 THEN 'octobre' WHEN 11 THEN 'novembre' ELSE 'décembre' END,
       ' ', CAST(year(o_orderdate) + 10 AS STRING), chr(10), 'Le Doyen', chr(10), 'A', chr(10), 'Monsieur le Président de l', chr(39), 'Université', chr(10),
       CASE WHEN o_orderkey % 5 = 0 THEN concat('Bordereau d', chr(39), 'envoi', chr(10)) WHEN o_orderkey % 7 = 0 THEN concat('Note de service', chr(10)) ELSE '' END,
       'Objet : Dossier ', o_orderpriority, ' du client ', CAST(o_custkey AS STRING), chr(10), chr(10),
       'Monsieur le Président,', chr(10), 'J', chr(39), 'ai l', chr(39), 'honneur de vous transmettre le dossier du client ', CAST(o_custkey AS STRING), ' pour suite à donner.', chr(10),
       'Veuillez agréer, Monsieur le Président, mes salutations.') AS texte_complet
FROM {orders}
"""


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, dealt to all cores where it has fewer splits than there are: the rules cost far more than reading. Tables with more stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, texte_complet."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return spark.sql(LETTERS_SQL, orders=dealt(orders, "o_orderkey"))


#: The same as a DuckDB common table expression.
LETTERS_CTE = "letters AS (" + LETTERS_SQL.replace("{orders}", "orders").replace("AS STRING", "AS VARCHAR") + ")"

CONFIDENCE_KEYS = ("numero", "date", "objet", "expediteur", "destinataire", "type_document", "etablissement")


def courriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of letters' records, made from documents and labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    i = F.col("id")
    confidence = F.create_map(*(x for k, name in enumerate(CONFIDENCE_KEYS) for x in (F.lit(name), ((i * (k + 3)) % 101).cast("int"))))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0")).alias("numero"),
        F.lit(None).cast("string").alias("date_courrier"),
        F.substring(F.substring_index("text", "\n", 1), 1, 500).alias("objet"),
        F.col("source").alias("expediteur"),
        F.col("lang").alias("destinataire"),
        F.lit("lettre").alias("type_document"),
        F.substring("text", 200, 400).alias("corps"),
        F.col("text").alias("texte_complet"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "validated").otherwise("pending").alias("status"),
        F.col("n_chars").alias("n_chars"),
        (F.col("n_chars") % 997).cast("int").alias("processing_time_ms"),
        F.timestamp_add("MINUTE", (F.col("doc_id") % 97).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
    ).withColumn("confidence", F.when(i % 10 == 0, None).when(i % 10 == 1, F.create_map().cast("map<string,int>")).otherwise(confidence))


COURRIERS_CTE = """courriers AS (
  SELECT d.doc_id AS id, concat('doc-', d.doc_id, '.pdf') AS filename, concat(d.doc_id, '/', lpad(CAST(d.doc_id % 30 AS VARCHAR), 2, '0')) AS numero,
    substr(split_part(text, chr(10), 1), 1, 500) AS objet, source AS expediteur, lang AS destinataire, 'lettre' AS type_document,
    substr(text, 200, 400) AS corps, text AS texte_complet,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'validated' ELSE 'pending' END AS status, n_chars,
    CAST(n_chars % 997 AS INTEGER) AS processing_time_ms, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id % 97) AS created_at,
    CASE WHEN d.doc_id % 10 >= 2 THEN ((d.doc_id * 3) % 101 + (d.doc_id * 4) % 101 + (d.doc_id * 5) % 101 + (d.doc_id * 6) % 101
      + (d.doc_id * 7) % 101 + (d.doc_id * 8) % 101 + (d.doc_id * 9) % 101) / CAST(7 AS DOUBLE) END AS row_mean
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
