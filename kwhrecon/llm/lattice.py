"""Embedding near-dedup: random projections decoded to E8 lattice points.

A table draws 16 random directions; the two blocks of 8 coordinates are each
decoded to the nearest point of E8, and the pair of points is the cell. Every
vector lies at home in one cell per table and also looks into the ``probes``
neighbouring cells whose lattice vectors point along its residual, so a pair is
met if either one looks into the other's home in any table. Members of a cell
are compared by a matrix product, and only pairs whose cosine reaches the
threshold leave the task.

Scale: exactly equal vectors are one row (their class) from the start, so a
group of copies of any size costs a partial aggregate. Only ids and cell keys
are shuffled for the occupancy count; vectors are joined just to the rows of
cells that hold a home and another class. Cells above ``block`` members
are cut into blocks that meet block by block, in separate tasks; no member is
dropped and no cell is capped. A link belongs to the first cell in which its two
ends meet, which a task tells from their codes, so every link is known in one task
only: what leaves a task is each vector's number of links there and a spanning
forest of them, never the links themselves.

Edge cases: vectors that are null, zero, empty or hold null or non-finite
components link with nothing and are their own component. Vectors of different
lengths never link. Repeated ids give one row per id of the table's rows; there
are no ties, as links depend on the cosine alone. An empty table gives no rows.
Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, grouped, local_forest, read, stored
from .vectors import finite, matrix

TABLES, PROBES, SCALE, BLOCK, THRESHOLD, ROWS, PAIRS = 12, 8, 0.5, 2048, 0.9, 64, 1 << 20


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            rows.append([a if c == i else b if c == j else 0.0 for c in range(8)])
    rows += [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(rows)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, else turn the worst coordinate the other way."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(1) % 2)
    error = x[odd] - point[odd]
    worst = np.abs(error).argmax(1)
    point[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _keys(points: np.ndarray, mix: np.ndarray, salt: int) -> np.ndarray:
    """64-bit key of each row of doubled lattice coordinates."""
    h = (2 * points).astype(np.int64).astype(np.uint64) * mix
    h = h.sum(1, dtype=np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def cells(vectors: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n x tables) and looked-into cells (n x tables x probes) of unit vectors.

    Rows go through the products ``ROWS`` at a time, the last ones padded, so a vector's cells do not depend on its company.
    """
    n, dim = vectors.shape
    whole = np.zeros((-(-n // ROWS) * ROWS, dim))
    whole[:n] = vectors
    minimal = minimal_vectors()
    rng = np.random.default_rng([17, dim])
    home = np.empty((len(whole), tables), np.int64)
    near = np.empty((len(whole), tables, probes), np.int64)
    steps = np.zeros((2, 240, 16))
    steps[0, :, :8], steps[1, :, 8:] = minimal, minimal
    steps = steps.reshape(480, 16)
    by_rows = lambda x, y: np.concatenate([x[lo:lo + ROWS] @ y for lo in range(0, len(x), ROWS)]) if len(x) else x @ y
    for t in range(tables):
        x = by_rows(whole, rng.standard_normal((dim, 16)) * scale)
        mix = rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
        point = np.hstack([nearest_e8(x[:, :8]), nearest_e8(x[:, 8:])])
        residual = x - point
        along = np.hstack([by_rows(np.ascontiguousarray(residual[:, :8]), minimal.T), by_rows(np.ascontiguousarray(residual[:, 8:]), minimal.T)])
        best = np.argpartition(-along, probes, axis=1)[:, :probes]
        salt = dim * 1000 + t
        home[:, t] = _keys(point, mix, salt)
        for p in range(probes):
            near[:, t, p] = _keys(point + steps[best[:, p]], mix, salt)
    return home[:n], near[:n]


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one; the largest component goes first, so no square overflows."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cell_rows(batches, tables: int, probes: int, scale: float):
    for batch in batches:
        ids, sizes = batch.column(0).to_numpy(), np.asarray(batch.column(2))
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            for lo in range(0, len(at), 1024):
                part = at[lo:lo + 1024]
                home, near = cells(_unit(matrix(batch.column(1).take(pa.array(part)))), tables, probes, scale)
                n = tables * (1 + probes)
                key = np.concatenate([home, near.reshape(len(part), -1)], axis=1).ravel()
                is_home = np.tile(np.r_[np.ones(tables, bool), np.zeros(tables * probes, bool)], len(part))
                yield pa.RecordBatch.from_pydict({"cell": key, "rep": np.repeat(ids[part], n), "home": is_home})


def first_meeting(home: np.ndarray, codes: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, which of x and y is at home) of the first meeting of each pair of rows; the smaller id's home goes first.

    ``home`` is n x tables, ``codes`` n x tables x cells: the home cell and those looked into.
    """
    table, host = np.full(len(x), -1), np.full(len(x), -1)
    low = np.where(ids[x] < ids[y], x, y)
    high = np.where(ids[x] < ids[y], y, x)
    for t in range(home.shape[1]):
        for mine, other in ((low, high), (high, low)):
            meet = (table < 0) & (codes[other, t] == home[mine, t][:, None]).any(1)
            table[meet], host[meet] = t, mine[meet]
    return table, host


def _facts_of_cells(batches, tables: int, probes: int, scale: float, threshold: float):
    """Of the links whose ends first meet in a block: numbers of links of each vector, and a spanning forest."""
    for table, offsets in grouped(batches, ["cell", "i", "j"]):
        ids, home, copies = table["rep"].to_numpy(), table["home"].to_numpy(), table["copies"].to_numpy()
        lengths = table["embedding"].combine_chunks().value_lengths().to_numpy()
        found, n = [], 0
        for lo, hi in itertools.pairwise(offsets):
            own, look = np.flatnonzero(home[lo:hi]), np.flatnonzero(~home[lo:hi])
            if not len(own) or not len(look):
                continue
            v = _unit(np.asarray(table["embedding"].slice(lo, hi - lo).combine_chunks().flatten()).reshape(hi - lo, lengths[lo]))
            x, y = np.nonzero(v[own] @ v[look].T >= threshold)
            x, y = own[x] + lo, look[y] + lo
            x, y = x[ids[x] != ids[y]], y[ids[x] != ids[y]]
            if len(x):
                found.append((x, y))
                n += len(x)
            if n > PAIRS or hi == offsets[-1]:
                if found:
                    yield from _first_links(table, ids, copies, lengths, *map(np.concatenate, zip(*found)), tables, probes, scale)
                found, n = [], 0


def _first_links(table, ids, copies, lengths, x, y, tables: int, probes: int, scale: float):
    """The facts of those pairs of rows (x at home) that meet for the first time; codes are made once per vector."""
    cell = table["cell"].to_numpy()
    for dim in np.unique(lengths[x]):
        some = lengths[x] == dim
        _, row, at = np.unique(ids[np.r_[x[some], y[some]]], return_index=True, return_inverse=True)
        row = np.r_[x[some], y[some]][row]
        here, weight = ids[row], copies[row]
        home, near = cells(_unit(matrix(table["embedding"].combine_chunks().take(pa.array(row)))), tables, probes, scale)
        codes = np.concatenate([home[:, :, None], near], axis=2)
        a, b, where = at[:some.sum()], at[some.sum():], cell[x[some]]
        when, host = first_meeting(home, codes, here, a, b)
        first = (host == a) & (home[a, when] == where)
        a, b = a[first], b[first]
        if not len(a):
            continue
        links = np.bincount(a, weight[b], len(here)) + np.bincount(b, weight[a], len(here))
        linked = np.flatnonzero(links)
        u, w = local_forest(here[a], here[b])
        yield pa.RecordBatch.from_pydict({
            "rep": np.concatenate([here[linked], u]),
            "least": pa.array(np.concatenate([np.zeros(len(linked), np.int64), w]), mask=np.arange(len(linked) + len(u)) < len(linked)),
            "others": np.concatenate([links[linked].astype(np.int64), np.zeros(len(u), np.int64)])})


def near_facts(classes: DataFrame, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
               block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, least, others) of classes (rep, embedding, copies): rows without ``least`` count linked vectors, the others are edges of a forest."""
    codes = stored(classes.select("rep", "embedding", F.size("embedding").alias("dim"))
                   .mapInArrow(lambda b: _cell_rows(b, tables, probes, scale), "cell long, rep long, home boolean"))
    met = stored(codes.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes"),
                                           F.min("rep").alias("lo"), F.max("rep").alias("hi"))
                 .where("homes > 0 and lo < hi")
                 .select("cell", F.ceil(F.col("n") / block).cast("int").alias("m")))
    live = stored(codes.join(met, "cell"))
    part = F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    own = live.where("home").select("cell", "rep", "home", part.alias("i"), every.alias("j"))
    # every member looks in, those at home too: two members meet where the one lies at home and the other looks in, once
    look = live.select("cell", "rep", F.lit(False).alias("home"), every.alias("i"), part.alias("j"))
    rows = (own.unionByName(look).join(classes.select("rep", "embedding", "copies"), "rep")
            .repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "home", "rep"))
    return rows.select("cell", "i", "j", "rep", "home", "copies", "embedding").mapInArrow(
        lambda b: _facts_of_cells(b, tables, probes, scale, threshold), "rep long, least long, others long")


def near_dedup(vectors: DataFrame, **parameters) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    nonzero = finite("embedding") & F.exists("embedding", lambda v: v != 0)
    usable = rows.where(nonzero)
    classes = stored(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    found = stored(near_facts(classes, **parameters))
    degree = found.where("least is null").groupBy("rep").agg(F.sum("others").alias("others"))
    comp = components(found.where("least is not null"), "rep", "least").withColumnRenamed("node", "rep")
    facts = stored(classes.join(degree, "rep", "left").join(comp, "rep", "left")
                   .select("embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                           F.coalesce("component_id", "rep").alias("component_id")))
    met = usable.join(facts, "embedding")
    alone = rows.where(~nonzero).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (met.select("vec_id", "n_links", "component_id").unionByName(alone)
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all rows of ``embeddings``, whatever their labels."""
    return near_dedup(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(n, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT n, min(r) AS c FROM reach GROUP BY n),
deg AS (SELECT a, count(*) AS d FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(d, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN comp ON n = vec_id LEFT JOIN deg ON a = vec_id
"""
