"""Exact top-k inner-product search with vector-approximation files.

Components are quantised into 16 cells per dimension and block.  For a query, a
cell bounds what its component can add to the score from above and below; the
sum over dimensions bounds the score.  Per query and block, the k-th largest
lower bound discards most vectors; the others are read exactly in the order of
their upper bounds until the k-th score found exceeds every bound that is left.
Queries and candidates meet in blocks (a stated query set against all rows),
and the best k of the blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage

CELLS = 16
QUERY_BLOCK, DATA_BLOCK = 2048, 8192
#: Vectors read exactly at a time.
STEP = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers of each component and the cells' edges, by dimension; cells hold about equally many values."""
    at = np.linspace(0, len(x) - 1, CELLS + 1).round().astype(int)
    edges = np.sort(x, axis=0)[at]
    cell = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        cell[:, d] = np.clip(np.searchsorted(edges[:, d], x[:, d], "right") - 1, 0, CELLS - 1)
    return cell, edges


def bounds(cell: np.ndarray, edges: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of every query with every vector."""
    dims = np.arange(cell.shape[1])
    low, high = edges[cell, dims].astype(np.float64), edges[np.minimum(cell + 1, CELLS), dims].astype(np.float64)
    plus, minus = np.maximum(query, 0).astype(np.float64), np.minimum(query, 0).astype(np.float64)
    # beyond 2**50 doubles round: both bounds give way by more than that can come to
    slack = float(np.abs(query.astype(float)).max(initial=0)) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * len(dims)
    slack = slack * len(dims) * 2.0**-50 if slack > 2.0**50 else 0.0
    return np.clip(plus @ low.T + minus @ high.T - slack, float(LEAST), float(MOST)), np.clip(plus @ high.T + minus @ low.T + slack, float(LEAST), float(MOST))


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; those that may leave 64 bits are added up in whole numbers of any size, and beyond 64 bits count as the nearest number within."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**62:
        return x @ query
    return np.array([min(max(sum(map(int.__mul__, row, query.tolist())), LEAST), MOST) for row in x.tolist()], np.int64)


def search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, id, score) of each query's best k, ties to smaller ids, and how many vectors were read exactly."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    cell, edges = approximate(x)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    read = 0
    for b in range(0, len(query), 256):
        low, high = bounds(cell, edges, query[b : b + 256])
        for q in range(len(low)):
            own, lo, hi = ids == qids[b + q], low[q], high[q]
            lo = np.where(own, -np.inf, lo)
            least = np.partition(lo, -k)[-k] if len(lo) > k else -np.inf
            may = np.flatnonzero((hi >= least) & ~own)
            may = may[np.argsort(-hi[may], kind="stable")]
            score, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for s in range(0, len(may), STEP):
                if len(score) == k and score[-1] > hi[may[s]]:
                    break
                part = may[s : s + STEP]
                read += len(part)
                score, found = np.concatenate((score, products(x[part], query[b + q]))), np.concatenate((found, part))
                best = np.lexsort((found, -score))[:k]
                score, found = score[best], found[best]
            out.append((np.full(len(found), qids[b + q]), ids[found], score))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, read
    return *(np.concatenate(c) for c in zip(*out, strict=True)), read


def _stack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors (shorter ones padded with zeros), which are queries."""
    vec = table["v"].combine_chunks()
    n = np.asarray(pc.list_value_length(vec)).astype(np.int64)
    flat = np.asarray(vec.flatten())
    x = np.zeros((len(n), max(1, int(n.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return np.asarray(table["vec_id"]), x, np.asarray(table["is_query"])


def _block(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x, is_query = _stack(table)
        a, b, s, _ = search(ids[~is_query], x[~is_query], ids[is_query], x[is_query], k) if is_query.any() and not is_query.all() else (*[np.zeros(0, np.int64)] * 3, 0)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "v") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products; ids equal to the query's are left out.

    Vectors are arrays of whole numbers.  Null ids and null vectors, and vectors
    with a null in them, take no part; vectors of fewer dimensions count as
    padded with zeros, empty ones too.  Equal scores go to the smaller id.  Rows
    that repeat an id are rows of their own.  Components and scores beyond
    64 bits count as the nearest number within.  No
    queries or no vectors give no rows.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("long")).alias("v")).where("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    data, asked = stage(spark, pick(vectors), "vectors"), stage(spark, pick(queries), "queries")
    rows, cols = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-data.count() // DATA_BLOCK))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(spread(rows, 1).alias("qb"), every(cols).alias("db"), "vec_id", "v", F.lit(True).alias("is_query"))
    right = data.select(every(rows).alias("qb"), spread(cols, 2).alias("db"), "vec_id", "v", F.lit(False).alias("is_query"))
    found = left.unionByName(right).groupBy("qb", "db").applyInArrow(_block(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, floor(64 * x) of each component as double; vectors with null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    ok = embeddings.where(F.col("embedding").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return ok.select("vec_id", F.transform(x, lambda e: F.floor(e * 64)).alias("v"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where("vec_id % 20 = 0"))


QUERIES = {"op7_topk": op7_topk}
ORACLE_SQL = {
    "op7_topk": """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(coalesce(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]), 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
}
