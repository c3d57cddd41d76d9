"""Hard negatives for labelled vectors, scored by a residue-number-system matrix product.

Scores are inner products of whole numbers. A block of anchors and a block of
rows are reduced modulo several small primes, each residue matrix is multiplied
in float32 (``depth`` columns at a time, so that every sum stays below 2 ** 24
and is exact), and the signed scores are put together from the residues by
mixed-radix Chinese remaindering. As many primes are taken as the block's
largest possible score needs, so scores are exact at any size of component.

Plan. Anchors first meet the rows of their own label: each label is cut into
shards of about ``shard`` rows and tiles of about ``tile`` anchors, whatever its
size, and each block keeps the best ``positives`` of every anchor; lists are
merged ``fan_in`` shards at a time. Then all anchors, with the window of scores
that each positive opens, meet all rows in the same manner, and each block keeps
the best rows of another label inside each window. The two steps multiply each
anchor with each row about once. Data moved is anchors x shards + rows x tiles
rows of vectors, and lists of bounded length after that; no task holds more than
a tile, a shard and one slice of their product.

Edge cases: rows with a null id, label or vector, or with any null or
non-finite component (also one that only scaling makes infinite) take no part;
empty vectors and zero vectors do. Vectors of different lengths are never
compared. Rows with the anchor's own id are neither positives nor negatives of
it; other repeated rows each count. An anchor given twice by equal rows is one
anchor; rows with one id but another label or vector are anchors of their own.
Ties go to the smaller id. Scores beyond 64 bits count as the nearest long.
An anchor without positives, or a positive whose window is empty (such as every
negative score), gives no rows. Empty tables give no rows. Other columns, of
whatever name, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import finite, matrix

TILE, SHARD, FAN_IN, SLICE = 1024, 8192, 32, 64
#: A negative's score lies between these shares of the positive's, in tenths.
LOWEST, HIGHEST = 3, 9
LONG = (1 << 63) - 1


def moduli(bound: int) -> list[int]:
    """Odd primes, those below 256 first (largest first), whose product tells whole numbers of up to +-bound apart."""
    sieve = [n for n in range(3, 2048, 2) if all(n % d for d in range(3, math.isqrt(n) + 1, 2))]
    out, product = [], 1
    for p in [n for n in reversed(sieve) if n < 256] + [n for n in sieve if n > 256]:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole float64 numbers modulo p, from -(p - 1) / 2 to (p - 1) / 2."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r))


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p as int64 from 0 to p - 1; every float32 sum is exact."""
    x, y = balanced(a, p).astype(np.float32), balanced(b, p).astype(np.float32)
    depth = max(1, (1 << 24) // ((p - 1) // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, a.shape[1], depth):
        total += np.rint(x[:, lo:lo + depth] @ y[:, lo:lo + depth].T).astype(np.int64)
    return total % p


def from_residues(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers with these residues, by mixed-radix digits; Python integers where a long is too short."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        value, weight = np.zeros_like(residues[i]), 1
        for d, q in zip(digits, primes):
            value = (value + d * weight) % p
            weight = weight * q % p
        digits.append((residues[i] - value) * pow(weight, -1, p) % p)
    product = math.prod(primes)
    wide = product >= 1 << 62
    total = np.zeros(residues[0].shape, object if wide else np.int64)
    weight = 1
    for d, p in zip(digits, primes):
        total += d.astype(object) * weight if wide else d * weight
        weight *= p
    total = np.where(total > product // 2, total - product, total)
    return np.clip(total, -LONG - 1, LONG).astype(np.int64) if wide else total


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole float64 numbers, as int64."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    primes = moduli(max(bound, 1))
    return from_residues([residue_product(a, b, p) for p in primes], primes)


def window(positive: int) -> tuple[int, int]:
    """The least and the greatest negative score of a positive's window, in whole numbers."""
    return -((-LOWEST * positive) // 10), HIGHEST * positive // 10


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; the first ones of equal scores."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[:k - len(above)]]


def _sides(rows: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Anchors, candidates in order of their ids, and the candidates' ids and labels."""
    asks = rows["asks"].to_numpy()
    left, right = rows.take(np.flatnonzero(asks)), rows.take(np.flatnonzero(~asks))
    right = right.take(np.argsort(right["vec_id"].to_numpy(), kind="stable"))
    return left, right, right["vec_id"].to_numpy(), right["label"].to_numpy()


def _positives_of_block(rows: pa.Table, k: int) -> pa.Table:
    """The best rows of the anchors' own label in one block."""
    left, right, ids, labels = _sides(rows)
    out: dict[str, list] = {"anchor": [], "vec_id": [], "score": []}
    candidates = matrix(right["ints"]) if len(right) else None
    for lo in range(0, len(left) if len(right) else 0, SLICE):
        part = left.slice(lo, SLICE)
        for key, own, label, row in zip(part["anchor"].to_pylist(), part["vec_id"].to_pylist(), part["label"].to_pylist(),
                                        exact_scores(matrix(part["ints"]), candidates)):
            use = np.flatnonzero((labels == label) & (ids != own))
            pick = use[best(row[use], k)]
            out["anchor"] += [key] * len(pick)
            out["vec_id"] += ids[pick].tolist()
            out["score"] += row[pick].tolist()
    return pa.table({"anchor": pa.array(out["anchor"], pa.string()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                     "score": pa.array(out["score"], pa.int64()),
                     "shard": pa.array([rows["shard"][0].as_py()] * len(out["score"]), pa.int64())})


def _negatives_of_block(rows: pa.Table, k: int) -> pa.Table:
    """The best rows of other labels in each window of each anchor in one block."""
    left, right, ids, labels = _sides(rows)
    out: dict[str, list] = {"anchor": [], "place": [], "vec_id": [], "score": []}
    candidates = matrix(right["ints"]) if len(right) else None
    for lo in range(0, len(left) if len(right) else 0, SLICE):
        part = left.slice(lo, SLICE)
        for key, own, label, opened, row in zip(part["anchor"].to_pylist(), part["vec_id"].to_pylist(), part["label"].to_pylist(),
                                                part["opened"].to_pylist(), exact_scores(matrix(part["ints"]), candidates)):
            use = np.flatnonzero((labels != label) & (ids != own))
            scores = row[use]
            for positive in opened:
                low, high = window(positive["positive_score"])
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                pick = use[inside[best(scores[inside], k)]]
                out["anchor"] += [key] * len(pick)
                out["place"] += [positive["place"]] * len(pick)
                out["vec_id"] += ids[pick].tolist()
                out["score"] += row[pick].tolist()
    return pa.table({"anchor": pa.array(out["anchor"], pa.string()), "place": pa.array(out["place"], pa.int32()),
                     "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.int64()),
                     "shard": pa.array([rows["shard"][0].as_py()] * len(out["score"]), pa.int64())})


def _merged(lists: DataFrame, keys: list[str], k: int, fan_in: int, rounds: int) -> DataFrame:
    """The best k rows per key out of lists of many shards, ``fan_in`` lists at a time; adds ``rank``."""
    order = [F.desc("score"), F.asc("vec_id")]
    for _ in range(rounds):
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("long"))
        ranked = F.row_number().over(Window.partitionBy(*keys, "shard").orderBy(*order))
        lists = lists.withColumn("rank", ranked).where(F.col("rank") <= k)
    return lists.drop("shard")


def _rounds(shards: int, fan_in: int) -> int:
    return max(1, math.ceil(math.log(max(shards, 2), fan_in)))


def scaled(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of every component, as whole doubles."""
    return F.transform(vector, lambda x: F.when(F.abs(x * factor) < 2.0**52, F.floor(x * factor).cast("double")).otherwise(x * factor))


def usable(rows: DataFrame, vector: str, label: str, factor: int = 256) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part, each with a number, stored."""
    wide = rows.select(F.col("vec_id").cast("long"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("ints"))
    wide = wide.where(finite("ints") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    wide = wide.withColumn("ints", scaled("ints", factor)).where(finite("ints"))
    return stored(wide.withColumn("row", F.monotonically_increasing_id()))


def hard_negatives(base: DataFrame, asks: Column, positives: int = 5, negatives: int = 10, tile: int = TILE,
                   shard: int = SHARD, fan_in: int = FAN_IN) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``base`` comes from ``usable``; ``asks`` picks the anchors among its rows.
    """
    def places(n: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), n)

    def spread(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def blocks(n, size: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / size)).cast("long")

    n_rows = base.count()  # one long
    anchors = base.where(asks).withColumn("anchor", F.md5(F.to_json(F.struct("vec_id", "label", "ints"))))
    anchors = stored(anchors.groupBy("anchor").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"),
                                                   F.first("ints").alias("ints"), F.min("row").alias("row")))
    n_anchors = anchors.count()
    side = ["anchor", "vec_id", "label", "ints", "dim", "tile", "shard", "asks"]
    # the anchors of a label meet the rows of that label; counts of a label set its tiles and shards
    per_label = base.groupBy("label").agg(blocks(F.count("*"), shard).alias("shards"))
    per_label = stored(per_label.join(anchors.groupBy("label").agg(blocks(F.count("*"), tile).alias("tiles")), "label"))
    left = (anchors.join(per_label, "label").withColumn("dim", F.size("ints"))
            .withColumns({"tile": places(F.col("tiles"), 1), "shard": spread(F.col("shards")), "asks": F.lit(True)}))
    right = (base.join(per_label, "label").withColumn("dim", F.size("ints"))
             .withColumns({"shard": places(F.col("shards"), 2), "tile": spread(F.col("tiles")), "asks": F.lit(False), "anchor": F.lit(None).cast("string")}))
    found = (left.select(*side).unionByName(right.select(*side)).groupBy("label", "tile", "shard", "dim")
             .applyInArrow(lambda rows: _positives_of_block(rows, positives), "anchor string, vec_id long, score long, shard long"))
    rounds = _rounds(math.ceil(n_rows / shard), fan_in)
    found = _merged(found, ["anchor"], positives, fan_in, rounds).select(
        "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = stored(found)
    # every anchor with the windows that its positives open meets every row; a block leaves out the anchor's label
    opened = found.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_score")).alias("opened"))
    shards, tiles = F.lit(max(1, math.ceil(n_rows / shard))).cast("long"), F.lit(max(1, math.ceil(n_anchors / tile))).cast("long")
    left = anchors.join(opened, "anchor").withColumn("dim", F.size("ints")).withColumns(
        {"tile": places(tiles, 3), "shard": spread(shards), "asks": F.lit(True)})
    right = base.withColumn("dim", F.size("ints")).withColumns(
        {"shard": places(shards, 4), "tile": spread(tiles), "asks": F.lit(False), "anchor": F.lit(None).cast("string"),
         "opened": F.lit(None).cast("array<struct<place:int,positive_score:bigint>>")})
    mined = (left.select(*side, "opened").unionByName(right.select(*side, "opened")).groupBy("tile", "shard", "dim")
             .applyInArrow(lambda rows: _negatives_of_block(rows, negatives), "anchor string, place int, vec_id long, score long, shard long"))
    mined = _merged(mined, ["anchor", "place"], negatives, fan_in, rounds).select(
        "anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return mined.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: rows of ``embeddings`` whose vec_id is divisible by 100 as anchors, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(rows.withColumn("label", moved), "embedding", "label"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT min(row) AS anchor, vec_id, label, ints FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id, label, ints),
s AS (
  SELECT q.anchor, q.vec_id AS anchor_id, c.vec_id, c.row, q.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM q, v c WHERE c.vec_id <> q.vec_id AND len(q.ints) = len(c.ints)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS place FROM s WHERE same),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id, n.row) AS INT) AS rank
  FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same
    AND 100 * CAST(n.score AS HUGEINT) BETWEEN 30 * CAST(p.score AS HUGEINT) AND 90 * CAST(p.score AS HUGEINT)
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""
