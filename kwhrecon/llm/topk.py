"""Exact top-k search: tiled matrix products, partial selection, tree merge.

The stated queries are compared with every row in blocks: a tile of about
``tile`` queries times a shard of about ``shard`` candidates is one matrix
product in one task. Each tile keeps only the k best of its own per query;
lists of ``fan_in`` shards are then merged, round after round, until one list
per query is left. Work is queries x candidates by definition; data moved is
queries x shards + candidates x tiles rows, and no task holds more than a
tile, a shard and their product.

Edge cases: vectors that are null or hold null or non-finite components take
no part (neither as query nor as candidate). Vectors of different lengths are
never compared. Rows with the query's own id are no candidates; other repeated
rows each count, and a query id given twice has one list, of the best over its
rows. Ties go to the smaller id. Components and scores beyond 64 bits count as the
nearest long; very large ones are multiplied as Python integers, so all others are
exact. An empty table gives no rows. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import counted, finite, matrix

TILE, SHARD, FAN_IN = 1024, 8192, 32


def scaled_ints(vector: str, factor: int = 1024) -> Column:
    """floor(factor * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats where every sum stays below 2 ** 53, the nearest long beyond 64 bits."""
    size = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    largest = q.shape[1] * size(q) * size(c)
    if largest < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < 2**63:
        return q @ c.T
    wide = q.astype(object) @ c.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def _best_of_tile(rows: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one shard for each query of one tile."""
    left, right = rows.filter(pc.field("asks")), rows.filter(~pc.field("asks"))
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "shard": []}
    if len(left) and len(right):
        order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
        ids, own = right["vec_id"].to_numpy()[order], left["vec_id"].to_numpy()
        vectors = matrix(right["ints"])[order]
        shard = right["shard"][0].as_py()
        for lo in range(0, len(own), 64):
            scores = _products(matrix(left["ints"].slice(lo, 64)), vectors)
            for q, row in zip(own[lo:lo + 64], scores):
                use = np.flatnonzero(ids != q)
                row = row[use]
                if len(row) > k:
                    floor = np.partition(row, len(row) - k)[len(row) - k]
                    above = np.flatnonzero(row > floor)
                    pick = np.r_[above, np.flatnonzero(row == floor)[: k - len(above)]]
                else:
                    pick = np.arange(len(row))
                out["query_id"] += [int(q)] * len(pick)
                out["vec_id"] += ids[use[pick]].tolist()
                out["score"] += row[pick].tolist()
                out["shard"] += [shard] * len(pick)
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                     "score": pa.array(out["score"], pa.int64()), "shard": pa.array(out["shard"], pa.int64())})


def exact_top_k(queries: DataFrame, base: DataFrame, k: int = 10, tile: int = TILE, shard: int = SHARD,
                fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``base`` with the highest inner product.

    Both inputs have ``vec_id`` and ``ints`` (array of long, no nulls).
    """
    tiles = max(1, math.ceil(counted(queries) / tile))
    shards = max(1, math.ceil(counted(base) / shard))
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", "ints", F.lit(seed)), F.lit(n).cast("long"))
    left = queries.select("vec_id", "ints", F.size("ints").alias("dim"), place(tiles, 1).alias("tile"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                          F.lit(True).alias("asks"))
    right = base.select("vec_id", "ints", F.size("ints").alias("dim"), place(shards, 2).alias("shard"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"),
                        F.lit(False).alias("asks"))
    # the widest list per pair of blocks: one task, k rows per query
    lists = (left.unionByName(right).groupBy("tile", "shard", "dim")
             .applyInArrow(lambda rows: _best_of_tile(rows, k), "query_id long, vec_id long, score long, shard long"))
    order = [F.desc("score"), F.asc("vec_id")]
    while True:
        shards = math.ceil(shards / fan_in)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("long"))
        merged = Window.partitionBy("query_id", "shard").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: rows whose vec_id is divisible by 100 against all rows of ``embeddings``."""
    base = (spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite("embedding"))
            .select("vec_id", scaled_ints("embedding").alias("ints")).where("vec_id is not null"))
    return exact_top_k(base.where("vec_id % 100 = 0"), base)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.ints) = len(c.ints)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
