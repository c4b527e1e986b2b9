"""Operator 3, line dedup in Spark expressions only.

Texts are exploded into lines, each line's key is hashed (128 bits: two 64-bit hashes with different seeds), keys found
in at least ``min_docs`` documents lose all their lines except in the smallest doc_id that holds them, and each document
is put together again by position.

Only hashes, document ids and positions are shuffled by key; counts are partial before the shuffle (for two documents
the smallest and the largest doc_id suffice). The shared keys are written to the shared folder first: both sides of the
join back on the key are then plain exchanges, which Spark splits where a key is hot (an aggregate below a join can't be
split). Whole texts are shuffled once, for the join with their dropped positions.

Defined results: a null or empty text is one empty line; rows with the same doc_id count as one document, and a null
doc_id as the largest of all; rows are told apart by doc_id and the text's hash, so repeated rows are treated alike;
an empty table gives an empty result; extra columns come along only with keep_columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import SPACES, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
MIN_DOCS = 2
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def deduplicated_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_columns: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text; with keep_columns also docs' row as ``doc``."""
    rows = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("d"),
        F.xxhash64("text").alias("th"),
        F.coalesce("text", F.lit("")).alias("t"),
        *([F.struct(*docs.columns).alias("doc")] if keep_columns else [F.struct("doc_id").alias("doc")]),
    )
    lines = (
        rows.select("d", "th", F.posexplode(F.split("t", "\n", -1)).alias("at", "line"))
        .select("d", "th", "at", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("d", "th", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"))
    )
    if min_docs == 2:
        shared = lines.groupBy("h", "g").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last")
    else:
        shared = lines.groupBy("h", "g").agg(F.min("d").alias("first"), F.count_distinct("d").alias("n")).filter(F.col("n") >= min_docs)
    shared = written(shared.select("h", "g", "first"), "shared-lines")
    dropped = (
        lines.join(shared, ["h", "g"])
        .filter("d <> first")
        .groupBy("d", "th")
        .agg(F.collect_set("at").alias("gone"))
    )
    whole = rows.join(dropped, ["d", "th"], "left").select("doc", "t", F.split("t", "\n", -1).alias("lines"), "gone")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return whole.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT rid, k.doc_id, i, line, (first IS NOT NULL AND k.doc_id <> first) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""
