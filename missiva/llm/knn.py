"""Operator 6, exact top-k search: a Voronoi kNN join by integer inner product.

* Every vector becomes integers, floor(scale * x).
* Pivots are a hash sample of at most ``max_pivots`` vectors. Data and queries belong to their nearest pivot; a region's
  summary is its row count and its largest distance to the pivot (one row a pivot reaches the driver).
* For a query q, a row of the region with pivot c and radius r scores at least q.c - |q| r and at most q.c + |q| r. The
  lower bounds and counts give a score that the k-th best can't be under, the query's own rows apart; regions whose upper
  bound is lower are left out.
* Regions, laid in a chain of near pivots, form cells of about ``block`` rows; a region above that is split by a hash of
  vec_id, so that no group is unbounded. A query goes only to the cells that its bounds ask for, in blocks of ``block``
  queries. Queries are dealt to blocks by their nearest region, so that those of a block ask for much the same cells, and
  data rows are copied only to the blocks that ask for their cell.
* Each pair of blocks is solved on its own; its k best rows a query meet in a last ranking.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
shorter vectors count as filled with zeros; every row with another vec_id is a candidate, repeated rows each; a query's
vec_id that occurs more than once is asked once (its smallest vector); quantised components and scores stop at the
range of a long; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.llm.common import written

SCALE = 1024
K = 10
EVERY = 100
MAX_PIVOTS = 512
BLOCK = 16384
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<long>) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x)).alias("q"))
    )


def _matrix(arrays: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width), np.int64)
    for i, x in enumerate(arrays):
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; floating point only where every sum is an exact integer in it."""
    most = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most < 2**52:
        return a.astype(float) @ b.astype(float).T
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


def solve(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best rows of one block for each query of one block: query ids, ids, scores."""
    out: tuple[list, list, list] = ([], [], [])
    for low in range(0, len(q), 256):
        scores = _products(q[low : low + 256], x)
        for query, row in zip(q_ids[low : low + 256], scores, strict=True):
            at = np.flatnonzero(ids != query)
            if len(at) > k:
                values = row[at]
                at = at[values >= np.partition(values, -k)[-k]]
            at = at[np.lexsort((ids[at], -row[at].astype(float) if row.dtype == float else ~row[at]))][:k]
            out[0].extend([int(query)] * len(at))
            out[1].extend(ids[at].tolist())
            out[2].extend(int(s) for s in row[at])
    return out


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots' order in a chain from each to the nearest one left."""
    left, order = set(range(1, len(pivots))), [0]
    while left:
        rest = sorted(left)
        order.append(rest[int(np.argmin(((pivots[rest] - pivots[order[-1]]) ** 2).sum(axis=1)))])
        left.discard(order[-1])
    return order


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, scale: int = SCALE, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = quantised(vectors, scale)
    is_query = F.col("vec_id") % every == 0
    rows, width, asked = data.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.count_if(is_query)).first()
    if not asked:
        return spark.createDataFrame([], schema)
    n_pivots = max(1, min(max_pivots, math.isqrt(rows)))
    drawn = data.select(F.xxhash64("vec_id", "q").alias("h"), "q").orderBy("h", "q").limit(n_pivots).collect()
    pivots = _matrix(pd.Series([r["q"] for r in drawn]), width).astype(float)
    pivots = pivots[_chain(pivots)]

    def assign(batches):
        for df in batches:
            x = _matrix(df["q"], width).astype(float)
            near = np.argmin((pivots**2).sum(axis=1) - 2 * x @ pivots.T, axis=1) if len(x) else np.zeros(0, int)
            yield pd.DataFrame({"vec_id": df["vec_id"], "q": df["q"], "region": near, "dist": np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))})

    placed = written(data.mapInPandas(assign, "vec_id long, q array<long>, region long, dist double"), "regions")
    summary = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # a row a pivot
    count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in summary:
        count[r["region"]], radius[r["region"]] = r["n"], r["radius"]

    # cells: neighbours in the chain share one; a large region has some of its own
    cell, parts, held, current = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), 0, 0
    for j, n in enumerate(count):
        if held and held + n > block:
            current, held = current + 1, 0
        cell[j], parts[j] = current, max(1, -(-int(n) // block))
        held += int(n)
    cells_parts = {int(c): int(parts[cell == c].max()) for c in np.unique(cell[count > 0])}

    def ask(batches):
        live = np.flatnonzero(count)
        for df in batches:
            x = _matrix(df["q"], width).astype(float)
            norm = np.sqrt((x**2).sum(axis=1))[:, None] * (1 + 1e-9)
            middle, spread = x @ pivots[live].T, norm * (radius[live] * (1 + 1e-9))
            slack = 1e-6 * (1 + np.abs(middle))
            low, high = middle - spread - slack, middle + spread + slack
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(count[live][order], axis=1) >= k + df["own"].to_numpy()[:, None]  # a query's own rows are no candidates
            at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(live) - 1)
            bound = np.where(enough.any(axis=1), np.take_along_axis(low, order, 1)[np.arange(len(x)), at], -np.inf)
            out = []
            for i, (vec_id, q, qb) in enumerate(zip(df["vec_id"], df["q"], df["qb"], strict=True)):
                for c in np.unique(cell[live[high[i] >= bound[i]]]):
                    out += [(vec_id, q, int(c), part, qb) for part in range(cells_parts[int(c)])]
            yield pd.DataFrame(out, columns=["query_id", "q", "cell", "part", "qb"])

    # blocks of queries: neighbours in the chain share one, and a region with many queries has some of its own
    own = {r["region"]: r["n"] for r in placed.filter(is_query).groupBy("region").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    ends = np.cumsum([own.get(j, 0) for j in range(len(pivots))])
    first = (ends - [own.get(j, 0) for j in range(len(pivots))]) // block
    dealt = spark.createDataFrame([(j, int(first[j]), int(max(1, -(-int(ends[j]) // block) - first[j]))) for j in range(len(pivots))], "region long, first_block long, blocks long")
    queries = placed.filter(is_query).groupBy("vec_id").agg(F.min_by(F.struct("q", "region"), "q").alias("at"), F.count("*").alias("own"))
    queries = queries.select("vec_id", "own", "at.*").join(F.broadcast(dealt), "region")  # a row a pivot
    queries = queries.select("vec_id", "own", "q", (F.col("first_block") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).alias("qb"))
    asks = written(queries.mapInPandas(ask, "query_id long, q array<long>, cell long, part long, qb long"), "asks")
    lookup = spark.createDataFrame([(j, int(cell[j]), cells_parts.get(int(cell[j]), 1)) for j in range(len(pivots))], "region long, cell long, parts long")
    rows_in = (
        placed.join(F.broadcast(lookup), "region")  # a row a pivot
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
        .join(asks.groupBy("cell", "part", F.col("qb").alias("asking")).agg(F.lit(1)).select("cell", "part", "asking"), ["cell", "part"])
        .withColumnRenamed("asking", "qb")
        .select("vec_id", "q", "cell", "part", "qb")
    )

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = solve(left["query_id"].to_numpy(), _matrix(left["q"], width), right["vec_id"].to_numpy(), _matrix(right["q"], width), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True))).astype("int64")

    keys = ("cell", "part", "qb")
    partial = asks.groupBy(*keys).cogroup(rows_in.groupBy(*keys)).applyInPandas(local, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
