"""Operator 1, quality rules: line-first cleaning in Spark expressions only.

Each line is held against three rules; lines that fail one go. A document that then has lost more than ``max_loss`` of
its words is rejected, as is one that fails the base conditions.

* punctuation: a line with words but without any sentence mark fails, as does one with over a tenth of symbols;
* navigation: a line with three or more free-standing separators fails;
* boilerplate: a line that holds one of the fixed phrases fails.

Blank lines pass. Defined results: a null or empty text has one empty line, no words, and fails the base conditions;
repeated rows are judged one by one; extra columns are not read; an empty table gives an empty result. No shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import SPACE_RUN, words_of

SYMBOLS = "[#*$%&|<>]"
SENTENCE_MARKS = "[.!?…。！？؟।]"
SEPARATORS = r"(^|\s)[|»›•·>](\s|$)"
MIN_SEPARATORS = 3
MAX_SYMBOL_PERCENT = 10
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "terms of use",
    "terms of service",
    "sign in to",
    "subscribe to our newsletter",
    "lorem ipsum",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS = 0.5


def line_passes(line: Column) -> Column:
    symbols = F.size(F.split(line, SYMBOLS, -1)) - 1
    return (
        F.coalesce(~line.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
        | (
            line.rlike(SENTENCE_MARKS)
            & (symbols * 100 <= F.length(line) * MAX_SYMBOL_PERCENT)
            & (F.size(F.split(line, SEPARATORS, -1)) <= MIN_SEPARATORS)
            & ~F.lower(line).rlike("|".join(BOILERPLATE))
        )
    )


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows of ``width`` at the sorted places ``starts`` cover."""
    return F.aggregate(
        F.transform(
            starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width)))
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def quality(docs: DataFrame, *, max_loss: float = MAX_LOSS, keep_columns: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, the base figures, base_failed, lost_words, kept and ``cleaned``.

    Three-word windows are compared by their 64-bit hashes within one document. With keep_columns, the columns of docs
    come along in the struct ``doc``.
    """
    start = docs.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("t"), *([F.struct(*docs.columns).alias("doc")] if keep_columns else [])
    )
    more = ["doc"] if keep_columns else []
    a = start.select("doc_id", "t", *more, words_of(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("lines"))
    b = a.select(
        "doc_id",
        *more,
        "lines",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        (F.size(F.split("t", SYMBOLS, -1)) - 1).alias("n_symbols"),
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"),
        F.filter("lines", line_passes).alias("good"),
        F.when(
            F.size("w") >= 3,
            F.transform(
                F.slice("w", F.lit(1), F.size("w") - 2),
                lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
            ),
        ).alias("tri"),
    )
    c = b.select(
        "doc_id",
        *more,
        "n_words",
        "word_chars",
        "n_symbols",
        "lines",
        (F.size("full") - F.size(F.array_distinct("full"))).alias("n_dup_lines"),
        F.when(F.size("good") < F.size("lines"), F.array_join("good", "\n")).alias("good_text"),
        F.when(
            F.size("tri") > F.size(F.array_distinct("tri")),
            F.array_sort(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    d = c.select(
        "doc_id",
        *more,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "good_text",
        "lines",
        F.array_sort(
            F.transform(
                F.filter(
                    "s",
                    lambda x, k: F.coalesce(x["h"] == F.get("s", k - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get("s", k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ).alias("starts"),
        F.coalesce(F.size(words_of(F.col("good_text"))), F.lit(0)).alias("good_words"),
    )
    n, repeat = F.col("n_words"), F.coalesce(_covered(F.col("starts"), 3), F.lit(0))
    e = d.select(
        "doc_id",
        *more,
        n.cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.when(F.col("good_text").isNull(), 0).otherwise(n - F.col("good_words")).cast("long").alias("lost_words"),
        F.coalesce("good_text", F.array_join("lines", "\n")).alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # the verdict reads a row number, so that a filter on it isn't pushed below the columns and works them out again
    f = e.withColumn("row_number", F.monotonically_increasing_id()).withColumn("base_failed", failed)
    return f.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.lit(max_loss) * F.col("n_words")) & (F.col("row_number") >= 0))


_LINE_SQL = r"""(NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR (
    regexp_matches(x, '[.!?…。！？؟।]')
    AND length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 100 <= length(x) * 10
    AND len(regexp_extract_all(x, '(?:^|[\x20\x09-\x0D])[|»›•·>](?:[\x20\x09-\x0D]|$)')) < 3
    AND NOT regexp_matches(lower(x), '""" + "|".join(BOILERPLATE) + "')))"

ORACLE_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         string_split(t, chr(10)) AS lines
  FROM d),
l AS (
  SELECT rid, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
         list_filter(lines, lambda x: """
    + _LINE_SQL
    + r""") AS good FROM w),
tri AS (
  SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS at FROM dup, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid),
s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ws) - len(list_filter(regexp_split_to_array(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS lost_words
  FROM w JOIN l USING (rid) LEFT JOIN cov USING (rid))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.5 * n_words AS kept
FROM s
"""
)
