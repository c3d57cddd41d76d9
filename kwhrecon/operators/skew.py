"""Joins that a hot key cannot pile into one task.

``hot_keys`` finds the keys that hold more than 1 / ``SHARE`` of the rows: rows are counted
per part of the hash range (at most ``PARTS`` counts reach the driver), and only the keys of
parts that are above the share are counted themselves (at most ``SHARE`` longs).
Without such a key the join is a plain one, and a side that lies by its key stays.
``salted_join`` deals the rows of those keys over many salts and copies the matching
rows of the other side, one per key, to each salt; all other keys join as they are.
The copies are bounded by ``SHARE`` keys times the salts, so the join is a plain
shuffle join that reads both sides once, whatever is under them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 256
PARTS = 16 * SHARE


def key_hash(on) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in on])


def hot_keys(df: DataFrame, on) -> list[int]:
    """Hashes of the keys ``on`` that hold more than 1 / ``SHARE`` of the rows."""
    hashed = df.select(key_hash(on).alias("_h"))
    part = F.pmod(F.col("_h"), F.lit(PARTS))
    sizes = hashed.groupBy(part.alias("_p")).count().collect()
    total = sum(r["count"] for r in sizes)
    full = [r["_p"] for r in sizes if r["count"] * SHARE > total]
    if not full:
        return []
    counts = hashed.where(part.isin(full)).groupBy("_h").count().where(F.col("count") * SHARE > F.lit(total))
    return [r["_h"] for r in counts.collect()]


def hot_groups(counts: DataFrame, on, n: str) -> list[int]:
    """The same from exact counts per key (column ``n``): at most ``SHARE`` of them."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * SHARE > F.lit(total)).select(key_hash(on)).collect()]


def salted_join(left: DataFrame, right: DataFrame, on, hot: list[int], how: str = "inner", spread=None) -> DataFrame:
    """``left`` joined to ``right`` (one row per key) on the columns ``on``; rows of the ``hot`` keys spread by ``spread`` (columns)."""
    if not hot:
        return left.join(right, list(on), how)
    salts = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = key_hash(on).isin(hot)
    place = F.pmod(F.xxhash64(*(spread or left.columns), F.lit(1)), F.lit(salts)).cast("int")
    dealt = left.withColumn("_salt", F.when(is_hot, place).otherwise(F.lit(0)))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(every)), [*on, "_salt"], how).drop("_salt")
