"""Operator 13, source divergence audit: how far apart the sources of a language are in their words.

A first pass counts the documents that hold each term, by the term's hash (a document says itself which distinct terms it
holds, so nothing is shuffled by document); terms in too few documents are known then, and the second pass counts only the
others by language, source and term, partially before the shuffle. Terms that share a hash are looked for and counted by
themselves. Each kept term is then pivoted into one row with an array that is indexed by the language's sources. Spark's higher-order
functions turn the array into rates and each source's rate into its differences to the sources after it; these
contributions are summed by pair, partially before the shuffle.

All arithmetic is exact: rates are whole billionths, divided in decimals where a product could leave a long.

Defined results: null text, lang and source read as ''; an empty or null text has no terms, but its group is there;
repeated rows are counted each; ties of a value go by the item's UTF-8 bytes; an empty table gives an empty result; extra
columns are not read. A language without kept terms has pairs of value 0 and no terms. Memory: a term's row holds one
number a source of its language; a language's sources travel in a broadcast only while there are at most BROADCAST_GROUPS
groups, kept hashes only while there are at most BROADCAST_TERMS, else in plain joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.llm.common import drop, written
from missiva.llm.line_dedup import LOWER, UPPER

#: What stands between terms: ASCII but for its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
#: (lang, source) groups up to which the languages' rows are broadcast; a row holds some tens of bytes a group.
BROADCAST_GROUPS = 100_000
#: Kept terms up to which their hashes are broadcast, some 50 bytes each.
BROADCAST_TERMS = 1_000_000


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1), "")


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact for any counts."""
    above, below = count + PRIOR, total + PRIOR * terms
    wide = above.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    exact = F.call_function("div", wide, below.cast("decimal(20,0)"))
    short = F.call_function("div", above * F.lit(SCALE).cast("long"), below)
    return 1 + F.when(above <= (1 << 63) // SCALE - 1, short).otherwise(exact)


def term_hash(term: str = "term") -> Column:
    """Of a language's term."""
    return F.xxhash64("lang", term)


def _held(docs: DataFrame, min_docs: int) -> DataFrame:
    """h: hashes of terms in at least min_docs of a language's documents; a document says itself which distinct terms it holds."""
    rows = docs.select("lang", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    counts = rows.groupBy(term_hash().alias("h")).agg(F.count("*").alias("docs"))
    return written(counts.filter(F.col("docs") >= min_docs).select("h"), "held-terms")


def _pivoted(docs: DataFrame, held: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, n, held: a row a kept term, with its occurrences in each source that has it."""
    rows = docs.select("lang", "source", F.explode(terms_of(F.col("text"))).alias("term"))
    few = held.count() <= BROADCAST_TERMS
    if few:
        rows = rows.withColumn("h", term_hash()).join(F.broadcast(held), "h", "left_semi")
    counts = rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"))
    if not few:  # counted first, looked up after
        counts = counts.withColumn("h", term_hash()).join(held, "h", "left_semi")
    pivot = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("held"))
    wide = written(pivot.withColumn("h", term_hash()), "wide-terms")
    clashes = written(wide.groupBy("h").agg(F.count("*").alias("terms")).filter("terms > 1"), "clashes")
    if clashes.isEmpty():
        return wide
    # terms that share a hash are counted by themselves
    apart = docs.select("lang", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).withColumn("h", term_hash())
    own = apart.join(clashes, "h", "left_semi").groupBy("lang", "term").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    alone = wide.join(clashes, "h", "left_anti")
    return written(alone.unionByName(wide.join(clashes, "h", "left_semi").join(own, ["lang", "term"], "left_semi").select(alone.columns)), "wide-terms")


def _languages(groups: DataFrame, wide: DataFrame) -> DataFrame:
    """One row a language: v (kept terms), total, sources (sorted structs of source, total)."""
    kept = wide.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("total"))
    full = groups.join(kept, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sources = full.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"), F.sum("total").alias("total"))
    terms = wide.groupBy("lang").agg(F.count("*").alias("v"))
    return sources.join(terms, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))


def _ranked(df: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = df.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.filter(F.col("rank") <= most)


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` the distances to the language's other sources, ``term`` the terms that a source uses most beyond its language."""
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    held = _held(read, min_docs)
    wide = _pivoted(read, held, min_docs)
    drop(held)
    groups = read.select("lang", "source").distinct()
    languages = written(_languages(groups, wide), "languages")
    n_groups = languages.agg(F.sum(F.size("sources"))).first()[0] or 0
    sized = F.broadcast(languages) if n_groups <= BROADCAST_GROUPS else languages
    joined = wide.join(sized.withColumnRenamed("total", "lang_total"), "lang")
    counted = F.map_from_entries("held")
    rates = F.transform("sources", lambda s: rate(F.coalesce(F.element_at("counted", s["source"]), F.lit(0)), s["total"], F.col("v")))
    vectors = joined.withColumn("counted", counted).select("lang", "term", "n", "v", "lang_total", "sources", "counted", rates.alias("p"))

    # pairs: each source's rate against those of the sources after it
    firsts = vectors.select("lang", "p", F.posexplode("p").alias("i", "own"))
    after = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda q: F.abs(q - F.col("own")))
    parts = firsts.select("lang", "i", F.posexplode(after).alias("step", "f"))
    sums = parts.groupBy("lang", "i", (F.col("i") + 1 + F.col("step")).alias("j")).agg(F.sum("f").alias("value"))
    both = sums.union(sums.select("lang", "j", "i", "value"))
    own = languages.select("lang", "sources", F.posexplode("sources").alias("i", "s")).select("lang", "i", F.col("s.source").alias("source"), F.posexplode("sources").alias("j", "o"))
    named = own.filter("i <> j").select("lang", "i", "j", "source", F.col("o.source").alias("item"))
    pairs = named.join(both, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))

    # terms: sources that use a term more than the language as a whole
    of_lang = rate(F.col("n"), F.col("lang_total"), F.col("v"))
    some = vectors.select("lang", F.col("term").alias("item"), of_lang.alias("q"), F.explode(F.arrays_zip("sources", "p")).alias("x"), "counted")
    above = some.filter(F.map_contains_key("counted", F.col("x.sources.source")) & (F.col("x.p") > F.col("q")))
    terms = above.select("lang", F.col("x.sources.source").alias("source"), "item", (F.col("x.p") - F.col("q")).alias("value"))

    out = [_ranked(df, most).select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, df, most in (("pair", pairs, None), ("term", terms, top))]
    return out[0].unionByName(out[1])


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total, any_value(v) AS v FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM gn JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM p JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM gn GROUP BY ALL) USING (lang) GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= 50
"""
