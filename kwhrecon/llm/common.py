"""Helpers shared by the operators: shared tables, sorted groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space and the controls 9 to 13 (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A private one serves only a local session that names none; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kwhrecon-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows restarts from these files when an executor
    is lost, and joins see their real size. The folder's owner removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kwhrecon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_hash_class(documents: DataFrame) -> DataFrame:
    """Document rows with the crc32 of the id as text, which fixes the folds."""
    return documents.withColumn("_crc", F.crc32(F.col("doc_id").cast("string").cast("binary")))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream of rows sorted by ``keys`` into tables of whole groups.

    Yields (table, offsets): group i is rows offsets[i] to offsets[i + 1]. Only
    the last, open group is carried over, so memory holds a batch and a group.
    """
    held: list[pa.Table] = []
    last = None

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(len(table) - 1, 0), dtype=bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ends = tuple(table.column(k)[0].as_py() for k in keys), tuple(table.column(k)[-1].as_py() for k in keys)
        if held and ends == (last, last):
            held.append(table)
            continue
        table = pa.concat_tables([*held, table]).combine_chunks()
        starts = cut(table)
        split = int(starts[-1]) if len(starts) else 0
        if split:
            yield table.slice(0, split), np.r_[0, starts]
        held, last = [table.slice(split)], ends[1]
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, np.r_[0, cut(table), len(table)]


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a spanning forest: each node linked with the least of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component_id) of every node that has an edge.

    Alternates large-star and small-star rounds: each node's edges are hung on
    the least node it knows, until only stars are left. A round is one
    aggregate with partial sums and one join, written to the shared folder;
    a node with very many edges is split by the skew rule of the join.
    Self links and null ends are ignored.
    """
    pairs = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where("u <> v").distinct())
    star = stored(pairs)
    state = None
    while True:
        # large star: every larger neighbour of u hangs on the least node around u
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # a node without a larger neighbour keeps its edges through its smaller neighbours
        large = stored(large)
        # small star: u and its smaller neighbours hang on the least of them
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        star = stored(small)
        now = star.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            break
        state = now
    out = star.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return out.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())


def by_document(documents: DataFrame, work: Callable, schema: str, columns: list[str], *args) -> DataFrame:
    """``mapInArrow`` over the named columns; ``work(ids..., texts, *args)`` per batch returns columns."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(*batch.columns, *args))

    return documents.select(*columns).mapInArrow(run, schema)
