"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: ``COORDINATES`` bins are filled in rounds. In each round every element
of the set is thrown into one bin by that round's hash; a bin keeps the least
value of the first round that reached it. A set much larger than the number of
bins fills them in a round or two, and rounds beyond ``COORDINATES`` each throw
all elements into one given bin, so every bin is full after twice as many. Two
sketches agree in a bin with the probability of their sets' similarity, and
their share of equal bins is concentrated around it.

1. Equal sets are one class from the start (least id), by a partial aggregate.
2. Classes meet in buckets: equal hashes of ``ROWS`` neighbouring coordinates.
   The bucket sizes come from a partial aggregate; classes alone in all their
   buckets are done.
3. In each bucket every class is compared exactly with the bucket's least class.
   Links make components. Where a bucket still has several, about ``PIVOTS`` of
   its members are compared with those of other components too; after that most
   of a bucket is known to hang together.
4. Members of a bucket that are still in different components meet block by
   block (``BLOCK`` members each, so no bucket is capped), first as sketches.
   Members of pairs whose sketches agree in at least ``NEAR`` of the bins meet
   again with their texts and are compared exactly; only links leave the block.

Comparison of a class with many others is cut into parts of ``BLOCK``; the sets
are rebuilt from the texts and compared in full. Only classes that share a
bucket ship their text. Links, components and fingerprints stay distributed.

Edge cases: null, empty and white-space texts have the empty set, link with
nothing and are their own component. Texts of fewer than ``WORDS`` words are one
shingle. Rows that repeat an id give a row each; if their texts differ, a link
of one of them links the id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, components, grouped, read, stored
from .words import mix, windows, word_hashes

WORDS, COORDINATES, ROWS, BLOCK, PIVOTS, NEAR = 5, 128, 4, 1024, 16, 0.6
#: Similarity of a link: PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 75
#: Probability that a pair just at the threshold shares no bucket: (1 - 0.75 ** 4) ** 32, about 5e-6.
BANDS = COORDINATES // ROWS


def shingles(text: str | None) -> np.ndarray:
    """The set of hashed word shingles, sorted."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"), lower=True)
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(windows(h, min(WORDS, len(h))) + np.uint64(min(WORDS, len(h))))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The coordinates of a set that is not empty."""
    t = COORDINATES
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(t, bool)
    for i in range(2 * t):
        h = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
        if i < t:
            bins = (h >> np.uint64(57)).astype(np.int64)
            value = (h << np.uint64(7)) ^ np.uint64(i)
            use = empty[bins]
            np.minimum.at(out, bins[use], value[use])
            empty[bins[use]] = False
        elif empty[i - t]:
            out[i - t], empty[i - t] = mix(h.min(keepdims=True))[0], False
        if not empty.any():
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of neighbouring coordinates."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def _sketch_rows(ids: pa.Array, texts: pa.Array) -> dict:
    sizes, keys, bands, prints = [], [], [], []
    for t in texts:
        s = shingles(t.as_py())
        sizes.append(len(s))
        if not len(s):
            keys.append(None)
            bands.append(None)
            prints.append(None)
            continue
        keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        c = sketch(s)
        bands.append(band_keys(c))
        prints.append((mix(c) >> np.uint64(56)).astype(np.uint8).tobytes())
    return {"doc_id": ids, "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()),
            "bands": pa.array(bands, pa.list_(pa.int64())), "print": pa.array(prints, pa.binary())}


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if not len(a) or not len(b) or PART * min(len(a), len(b)) < WHOLE * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return PART * both >= WHOLE * (len(a) + len(b) - both)


def _verify(batches):
    """Exact links of each centre (a row with b null) with the others of its part."""
    centre_of, centres = None, []
    for batch in batches:
        a, part, b = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        texts, out = batch.column(3), []
        for i, key in enumerate(zip(a, part)):
            if key != centre_of:
                centre_of, centres = key, []
            own = shingles(texts[i].as_py())
            if b[i] is None:
                centres.append(own)
            elif any(similar(c, own) for c in centres):
                out.append((a[i], b[i]))
        if out:
            x, y = zip(*out)
            yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets are similar; texts are (doc_id, text)."""
    parts = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    others = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    centres = (parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
               .join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text"))
    rows = (centres.unionByName(others).repartition("a", "part")
            .sortWithinPartitions("a", "part", F.col("b").isNotNull(), "b"))
    return rows.select("a", "part", "b", "text").mapInArrow(_verify, "a long, b long")


def _blocks(batches, pivots: bool):
    """Per block meeting: (table, ids, comp, candidates, rows of the left side).

    ``candidates(x, now)`` are the rows on the right whose pair with row x is
    due: in another component by ``now``, sketches equal in enough bins, and
    the block's bucket is the first that both share.
    """
    for table, offsets in grouped(batches, ["key", "i", "j"]):
        keys, ids, comp, side = (table[c].to_numpy() for c in ("key", "rep", "comp", "side"))
        prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
        bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(ids), BANDS)
        for lo, hi in itertools.pairwise(offsets):
            left, right = np.flatnonzero(side[lo:hi] == 0) + lo, np.flatnonzero(side[lo:hi] == 1) + lo

            def candidates(x, now):
                y = right[(now[right] != now[x]) & (ids[right] != ids[x] if pivots else ids[right] > ids[x])]
                y = y[(prints[y] == prints[x]).mean(1) >= NEAR]
                return y[bands[x][(bands[y] == bands[x]).argmax(1)] == keys[x]]

            yield table, ids, comp, candidates, left if len(right) else []


def _near_rows(batches, pivots: bool):
    """The rows of a block meeting that are in a pair to be compared."""
    last, due = None, None
    for table, _, comp, candidates, left in _blocks(batches, pivots):
        if table is not last:
            if last is not None and due.any():
                yield from last.filter(pa.array(due)).to_batches()
            last, due = table, np.zeros(len(table), bool)
        for x in left:
            y = candidates(x, comp)
            due[y] = True
            due[x] |= len(y) > 0
    if last is not None and due.any():
        yield from last.filter(pa.array(due)).to_batches()


def _close_links(batches, pivots: bool):
    """Links between members of a block meeting whose components differ.

    Links join components at once, so pairs that already hang together are
    passed over and a block gives out fewer links than members.
    """
    for table, ids, comp, candidates, left in _blocks(batches, pivots):
        now, sets, found = comp.copy(), {}, []

        def set_of(row):
            if ids[row] not in sets:
                sets[ids[row]] = shingles(table["text"][int(row)].as_py())
            return sets[ids[row]]

        for x in left:
            for k in candidates(x, now):
                if now[k] != now[x] and similar(set_of(x), set_of(k)):
                    found.append((ids[x], ids[k]))
                    now[now == now[k]] = now[x]
        if found:
            yield pa.RecordBatch.from_pydict({"a": np.array([f[0] for f in found]), "b": np.array([f[1] for f in found])})


def remaining_links(live: DataFrame, comp: DataFrame, sketches: DataFrame, texts: DataFrame, pivots: int | None) -> DataFrame:
    """Verified links (a, b) between members of a bucket in different components.

    With ``pivots`` only about so many members of a bucket, chosen by a hash, meet the others.
    """
    rows = stored(live.select("key", "rep").join(comp.select(F.col("node").alias("rep"), "component_id"), "rep", "left")
                  .select("key", "rep", F.coalesce("component_id", "rep").alias("comp")))
    apart = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                   .where("lo < hi").select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("m")))
    open_ = (rows.join(apart, "key").join(sketches, "rep")
             .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    columns = ["rep", "comp", "print", "bands"]
    if pivots:
        chosen = open_.where(F.pmod(F.xxhash64("rep", F.lit("pivot")), F.ceil(F.col("n") / pivots).cast("long")) == 0)
        left = chosen.select("key", F.lit(0).alias("i"), every.alias("j"), F.lit(0).alias("side"), *columns)
        right = open_.select("key", F.lit(0).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), *columns)
    else:
        left = open_.select("key", F.col("part").alias("i"), every.alias("j"), F.lit(0).alias("side"), *columns)
        right = open_.select("key", every.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), *columns)
    columns = ["key", "i", "j", "side", *columns]
    meet = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "rep")
    met = meet(left.unionByName(right)).select(*columns)
    near = stored(met.mapInArrow(lambda batches: _near_rows(batches, bool(pivots)), met.schema))
    whole = meet(near.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")).select(*columns, "text")
    return whole.mapInArrow(lambda batches: _close_links(batches, bool(pivots)), "a long, b long")


def near_dedup(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, print binary"
    sketched = stored(by_document(docs, _sketch_rows, schema, ["doc_id", "text"]))
    classes = stored(sketched.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    own = sketched.join(classes, ["set_key"]).where("doc_id = rep").dropDuplicates(["doc_id", "set_key"])
    own = stored(own.select("rep", "bands", "print"))  # one row per class
    placed = own.select("rep", F.explode("bands").alias("key"))
    buckets = stored(placed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).where("n > 1"))
    live = stored(placed.join(buckets.select("key", "centre"), "key"))
    # the texts of all classes that share a bucket, cut out once
    texts = stored(docs.hint("merge").join(live.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    star = stored(live.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    links = stored(verified(star, texts))
    comp = components(links, "a", "b")
    for pivots in (PIVOTS, None):
        more = stored(remaining_links(live, comp, own, texts, pivots))
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links, "a", "b")
    of_class = stored(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                      .select("set_key", F.coalesce("component_id", "rep").alias("component_id")))
    whole = sketched.select("doc_id", "n_shingles", "set_key")
    met = whole.where("set_key is not null").join(of_class, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = whole.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def own_keys(documents: DataFrame) -> DataFrame:
    """(key, text, row): every different (doc_id, text) with a number of its own, the row's columns packed in ``row``.

    The number is doc_id; above all ids come further texts of an id, and above them the rows without one. Of rows
    with the same id and text one stays.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*documents.columns).alias("row"))
    repeated = stored(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    plain = rows.where("id is not null").hint("merge").join(repeated, "id", "left_anti").select(F.col("id").alias("key"), "text", "row")
    again = rows.hint("merge").join(repeated, "id", "left_semi").unionByName(rows.where("id is null"))
    again = again.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["id", "hash"])
    again = stored(again.withColumn("place", F.monotonically_increasing_id()))  # numbers that stay as they are
    if again.isEmpty():
        return plain
    top = F.lit(rows.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0] + 1)
    least = again.where("id is not null").groupBy("id").agg(F.min("hash").alias("least"))
    key = F.when(F.col("hash") == F.col("least"), F.col("id")).otherwise(top + F.col("place") + F.when(F.col("id").isNull(), 2**61).otherwise(0))
    return plain.unionByName(again.join(least, "id", "left").select(key.alias("key"), "text", "row"))


def first_of_copies(documents: DataFrame) -> DataFrame:
    """The rows, with all of their columns, without those that are near copies of one before them.

    Rows are told apart by (doc_id, text): texts that differ under one id, and rows with a null id, are documents of
    their own and stay unless they are near copies of another; they come after all others in the order of ids.
    """
    keyed = own_keys(documents)
    kept = stored(near_dedup(keyed.select(F.col("key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("key")))
    return keyed.hint("merge").join(kept, "key", "left_semi").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every whole text of ``documents``."""
    return near_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM c),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(n, r) AS (SELECT rep, rep FROM c UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT n, min(r) AS m FROM reach GROUP BY n)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.m, s.doc_id) AS component_id, coalesce(comp.m, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.sh = list_sort(s.sh) AND len(s.sh) > 0 LEFT JOIN comp ON comp.n = c.rep
"""
