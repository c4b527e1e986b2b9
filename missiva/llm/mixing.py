"""Operator 2, mixing sources to target weights.

A document's size is its number of words. Tokens are summed per source (partial sums before the shuffle), targets follow
from the weights, a source's rate is target / size, and each document is emitted floor(rate) times, plus one copy with
the fraction as its probability, drawn from a hash of its doc_id, so that reruns agree.

Sources come in code point order, null last; the weights repeat along that order. All targets together are ``share``
times all sizes. A target stops at ``cap`` times its source's size, and what it can't take goes to the others by weight
until none is above. The number of sources isn't bounded: their table stays distributed, and only three sums a round
reach the driver.

Defined results: a null or empty text has size 0 and is taken 0 words; a null doc_id draws from the string "null";
repeated rows draw alike; an empty table gives an empty result; extra columns are kept by ``mixed`` and ignored else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import words_of, with_global_index, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, size): source, source_size, target; one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    placed = with_global_index(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = written(placed.select("source", "source_size", weight.cast("double").alias("weight")), "sources")
    limit = F.col("source_size") * float(cap)
    all_words, left_weight = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    total, left, capped = share * all_words, share * all_words, 0
    while True:  # each round puts at least one more source at its limit
        above = limit * F.lit(left_weight) <= F.col("weight") * F.lit(left)
        n, taken, weight_above, weight_all = weighted.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum("weight"), F.lit(0.0)),
        ).first()
        if n == capped:
            break
        capped, left, left_weight = n, total - taken, weight_all - weight_above
        if left_weight == 0:
            break
    target = F.when(F.lit(left_weight) == 0, limit).when(above, limit).otherwise(F.col("weight") * F.lit(left) / F.lit(left_weight or 1.0))
    return weighted.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) plus a copy with the fraction as its probability; uniform numbers are 52 bits of an MD5."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    whole = F.floor(rate)
    return whole + F.when(drawn.cast("double") / float(1 << 52) < rate - whole, 1).otherwise(0)


def mix(docs: DataFrame, *, keep_columns: bool = False, **how) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row; with keep_columns also docs' row as ``doc``."""
    narrow = docs.select("source", F.size(words_of(F.col("text"))).alias("size"))
    targets = source_targets(narrow, **how).withColumnRenamed("source", "__source")
    rows = docs.select(
        "doc_id",
        "source",
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
        *([F.struct(*docs.columns).alias("doc")] if keep_columns else []),
    )
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        joined.withColumn("copies", copies(F.col("doc_id"), rate).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("source", "__source")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    rows = mix(docs, keep_columns=True, **how).filter("copies > 0")
    return rows.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__n")).select("doc.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         2.0 * source_size AS cap FROM s),
o AS (
  SELECT *, 1.5 * (SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER b, 0) AS rem,
         (SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0) AS remw
  FROM r WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * remw <= weight * rem AS capped FROM o),
f AS (SELECT rem AS f_rem, remw AS f_remw FROM c WHERE NOT capped ORDER BY remw DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * CAST(f_rem AS DOUBLE) / CAST(f_remw AS DOUBLE) AS DOUBLE) END AS target
  FROM c LEFT JOIN f ON true),
p AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM k
"""
