"""Search by a trigram index: the same rows as records.search, without reading every text.

The index holds, for each field, which rows hold which three characters in a row (lower-cased as ``ilike`` does), in
partitions by the trigram's hash and sorted by trigram, so that a query reads only its own trigrams' pages; beside it, how
many rows each trigram has. Texts that are read together give a trigram's ids as one list, so that lists are exchanged and
sorted, not single postings. A query's literal parts, between its wildcards, give trigrams; its FEWEST rarest ones are
looked up and their lists of rows intersected by count. What is left is verified with ``ilike`` on the table. A field
whose query has no literal part of three characters is searched by ``ilike`` alone.

Defined results: null and empty fields have no trigrams; % and _ stay wildcards; a row appears once however many of its
fields match; an empty table gives an empty index and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions.patterns import let
from missiva.operators import records
from missiva.sources.letters import dealt

SIZE, PARTS = 3, 64
#: Characters and texts up to which texts are taken together.
TOGETHER, TEXTS = 1 << 22, 1 << 14
#: Trigrams that one query looks up, the rarest first.
FEWEST = 4
#: Candidates up to which the table is filtered by their ids, so that row groups outside their range aren't read; else they are joined.
LISTED_IDS = 1000


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text, which is split into its characters once."""

    def grams(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - SIZE), lambda i: F.concat(*(F.get(chars, i + k) for k in range(SIZE))))

    return F.when(F.char_length(F.lower(text)) >= SIZE, F.array_distinct(let(F.split(F.lower(text), ""), grams)))


def posting_lists() -> Callable:
    """A function from texts to their distinct trigrams: (trigrams, where each one's list begins and ends, the lists of places of texts)."""

    def lists(texts):
        """A tuple for each group of texts whose trigrams, by the letters that occur, and places fit a whole number together."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        here = np.zeros(0x110000, bool)
        here[codes] = True
        letters = np.flatnonzero(here)
        if len(letters) ** SIZE * len(texts) >= 1 << 63:
            for at, part in ((0, texts[: len(texts) // 2]), (len(texts) // 2, texts[len(texts) // 2 :])):
                yield from ((grams, ends, places + at) for grams, ends, places in lists(part))
            return
        sizes = np.array([len(t) for t in texts], np.int64)
        code = (np.cumsum(here) - 1)[codes]
        place = np.repeat(np.arange(len(texts)), sizes)
        n = max(len(codes) - SIZE + 1, 0)
        key = np.zeros(n, np.int64)
        for k in range(SIZE):
            key = key * len(letters) + code[k : n + k]
        key = np.unique((key * len(texts) + place[:n])[place[:n] == place[SIZE - 1 : n + SIZE - 1]])  # none across two texts
        gram, places = np.divmod(key, len(texts))
        begins = np.flatnonzero(np.diff(gram, prepend=-1))
        gram = gram[begins]
        each = np.stack([letters[gram // len(letters) ** (SIZE - 1 - k) % max(len(letters), 1)] for k in range(SIZE)], axis=1)
        joined = each.astype("<u4").tobytes().decode("utf-32-le")
        yield [joined[i : i + SIZE] for i in range(0, len(joined), SIZE)], np.append(begins, len(key)).astype(np.int32), places

    return lists


def postings(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, gram, n, ids: for texts that are read together, the ids of those that hold a trigram, and how many they are."""
    lists = posting_lists()

    def run(batches):
        for batch in batches:
            ids = batch["id"]
            for k, field in enumerate(fields):
                texts, a, size = batch[f"f{k}"].to_pylist(), 0, 0
                texts = [t or "" for t in texts]
                for b, text in enumerate([*texts, None]):
                    if b > a and (text is None or size + len(text) > TOGETHER or b - a == TEXTS):
                        for grams, ends, places in lists(texts[a:b]):
                            held = pa.ListArray.from_arrays(ends, ids.take(pa.array(places + a)))
                            yield pa.RecordBatch.from_arrays([pa.array([field] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(np.diff(ends)), held], ["field", "gram", "n", "ids"])
                        a, size = b, 0
                    size += len(text or "")

    lowered = df.select("id", *(F.lower(f).alias(f"f{k}") for k, f in enumerate(fields)))
    return lowered.mapInArrow(run, f"field string, gram string, n int, ids array<{df.schema['id'].dataType.simpleString()}>")


def build(df: DataFrame, path: str, fields: tuple[str, ...] = records.ALL_FIELDS) -> None:
    """Writes the index of df (id and fields) to ``path``; the lists have one shuffle."""
    rows = postings(dealt(df.select("id", *fields), "id"), fields).withColumn("part", _part(F.col("gram")))
    rows.repartition("part").sortWithinPartitions("part", "field", "gram").write.partitionBy("part").parquet(f"{path}/postings")
    counts = df.sparkSession.read.parquet(f"{path}/postings").groupBy("part", "field", "gram").agg(F.sum("n").alias("n"))
    counts.repartition("part").sortWithinPartitions("field", "gram").write.partitionBy("part").parquet(f"{path}/counts")


def query_grams(spark: SparkSession, query: str) -> list[tuple[int, str]]:
    """(part, trigram) of the query's literal parts, by the same expressions as the index."""
    rows = spark.createDataFrame([(p,) for p in re.split("[%_]", query)], "text string").select(F.explode(grams_of(F.col("text"))).alias("gram")).distinct()
    return sorted((r.part, r.gram) for r in rows.select(_part(F.col("gram")).alias("part"), "gram").collect())  # a query's own


def _mine(table: DataFrame, grams: list[tuple[int, str]], field: str) -> DataFrame:
    return table.filter(F.col("part").isin(sorted({p for p, _ in grams})) & F.col("gram").isin([g for _, g in grams]) & (F.col("field") == field))


def candidates(spark: SparkSession, path: str, query: str, field: str) -> DataFrame | None:
    """id of the rows that hold the query's rarest trigrams in the field; None if the query has none to look up."""
    grams = query_grams(spark, query)
    if not grams:
        return None
    held = spark.read.parquet(f"{path}/postings")
    counted = {r.gram: r.n for r in _mine(spark.read.parquet(f"{path}/counts"), grams, field).select("gram", "n").collect()}  # one number a trigram
    if len(counted) < len(grams):  # one of them is nowhere
        return held.select(F.explode("ids").alias("id")).limit(0)
    rarest = sorted(grams, key=lambda g: (counted[g[1]], g))[:FEWEST]
    return _mine(held, rarest, field).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("id")


def search(df: DataFrame, path: str, query: str, field: str = "all", limit: int = 50) -> DataFrame:
    """records.search by way of the index at ``path``."""
    spark, found = df.sparkSession, None
    for name in records.SEARCH_FIELDS.get(field, records.ALL_FIELDS):
        ids = candidates(spark, path, query, name)
        if ids is None:
            return records.search(df, query, field, limit)
        found = ids if found is None else found.unionByName(ids)
    found = found.distinct()
    few = [r.id for r in found.limit(LISTED_IDS + 1).collect()]  # at most LISTED_IDS + 1
    near = df.filter(F.col("id").isin(few)) if len(few) <= LISTED_IDS else df.join(found, "id", "left_semi")
    return records.search(near, query, field, limit)
