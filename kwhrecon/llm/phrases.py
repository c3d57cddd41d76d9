"""Phrase collocations by vertically partitioned, depth-truncated suffix trees.

Every word of a piece of text starts a suffix; a suffix is known by its first
``DEPTH`` words, as no phrase is longer. Suffixes are grouped by their prefixes
under a memory budget: a first word that starts at most a quarter of the budget's
suffixes is a prefix of its own, a more frequent one is extended by the next word,
and a pair that is still more frequent by the third. Prefixes are dealt to groups
that hold half a budget each on average. Each group's suffixes are sorted on their
own into a subtree: a leaf is a run of equal suffixes, a node's count is the total
of the leaves below it. Counts of the prefixes that were extended are known from
their extension.

Plan: three passes over the texts (words; pairs whose first word is too frequent;
suffixes), each combined per slice of text before anything is shuffled, so that a
word, line or passage of a third of the corpus is one row per slice. Suffixes
travel as 64-bit ids of their words in the order of the slice, which compresses
well; ids are checked to be different over the whole vocabulary, and made with
another seed where two words share one, so counts are exact. Subtrees are
built where the groups' shuffle puts them. Scores are joins of the subtree nodes
with each other, written tables under plain exchanges, which the skew rule can
split. The best phrases of a language are picked per part first. The driver gets
one long, the number of words.

Edge cases: a null text is an empty one and counts nothing; a null lang is
``und``. A very long text is cut at ends of pieces, and a piece without an end
between words, with the next words at hand; nothing is lost at a cut. Repeated rows
count as often as they occur. Ties: as the order says (score, count, phrase in
byte order), so ranks are whole. Products are decimals of 38 digits, exact while
no count passes 10 ** 15. An empty table gives no rows. Other columns, of whatever
name, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored
from .words import _LOWER, mix, word_hashes

DEPTH, BUDGET, LEAST, TOP, COVER = 3, 1 << 18, 10, 2000, 50
#: Bytes taken together; a slice of this size has fewer than 2 ** 21 different words, so three of them fit a long.
SLICE = 6 << 20
#: Characters that end a piece, and those between words (fixed by the contract).
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_KIND = np.array([2 if b in ENDS else 1 if b in BLANKS else 0 for b in range(256)], np.uint8)
_NEXT = re.compile(rb"[\x20\x09]*(?:[^\x20\x09.,;:!?\x0a-\x0d]+[\x20\x09]*){0,%d}" % (DEPTH - 1))
_STOP = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")


def parts_of(raw: bytes, size: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about ``size`` bytes: (bytes, how many of them hold words to count; the rest is what follows)."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(bytes([e]), at, at + size) for e in ENDS) + 1
        if end <= at:
            end = max(raw.rfind(bytes([b]), at, at + size) for b in BLANKS) + 1
        if end <= at:  # one word fills the part: take it whole
            stop = _STOP.search(raw, at + size)
            end = stop.end() if stop else len(raw)
        ahead = end if raw[end - 1] in ENDS else _NEXT.match(raw, end).end()
        yield raw[at:ahead], end - at
        at = end
    yield raw[at:], len(raw) - at


def slices(texts: Iterable[bytes], size: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """Texts joined to slices of about ``size`` bytes, long ones in parts; as ``parts_of``."""
    held, n = [], 0
    for raw in texts:
        if len(raw) > size:
            yield from parts_of(raw, size)
            continue
        if n + len(raw) > size:
            yield b"\n".join(held), n
            held, n = [], 0
        held.append(raw)
        n += len(raw) + 1
    if held:
        yield b"\n".join(held), n


def seed_of(lang: str, seed: int) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(f"{seed} {lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)[0]


def suffixes(raw: bytes, counted: int, depth: int, seed: np.uint64) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """The different suffixes of a slice: its words, their ids, the place in them of each of the first ``depth`` words (-1: none), and counts."""
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    kind = _KIND[b]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = kind == 0
    edge = np.flatnonzero(np.diff(inside))
    first, after = edge[0::2], edge[1::2]
    if not len(first):
        return pa.array([], pa.string()), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * depth, np.zeros(0, np.int64)
    ends = np.zeros(len(first) + 1, np.int32)
    np.cumsum(after - first, out=ends[1:])
    spelled = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(b[kind == 0].tobytes()))
    coded = spelled.dictionary_encode()
    ids = mix(word_hashes(b" ".join(coded.dictionary.cast(pa.binary()).to_pylist())) ^ seed)
    ids = np.maximum(ids, np.uint64(1)).view(np.int64)  # 0 stands for no word
    code, n = coded.indices.to_numpy().astype(np.int64) + 1, len(coded.dictionary) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    key, together = code.copy(), np.ones(len(code), bool)
    for k in range(1, depth):
        follows = np.zeros(len(code), bool)
        follows[:-k] = piece[k:] == piece[:-k]
        together &= follows
        key *= n
        key[together] += code[np.flatnonzero(together) + k]
    key, count = np.unique(key[first < counted], return_counts=True)
    places = []
    for _ in range(depth):
        key, place = np.divmod(key, n)
        places.append(place - 1)
    return coded.dictionary, ids, places[::-1], count


def counted_suffixes(documents: DataFrame, depth: int, size: int = SLICE, seed: int = 0) -> DataFrame:
    """Suffixes counted per slice: (lang, word, w1, n) of one word, else (w1, ..., n) by the ids of their words, 0 after the last."""
    names = [f"w{i + 1}" for i in range(depth)]

    def run(batches):
        for batch in batches:
            langs = batch.column(0).fill_null("und")
            texts = batch.column(1).cast(pa.binary())
            for lang in pc.unique(langs):
                own = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
                mark = seed_of(lang.as_py(), seed)
                for raw, counted in slices((texts[int(i)].as_py() or b"" for i in own), size):
                    words, ids, places, count = suffixes(raw, counted, depth, mark)
                    if depth == 1:
                        columns = {"lang": pa.array([lang.as_py()] * len(count), pa.string()), "word": words.take(pa.array(places[0])), "w1": ids[places[0]]}
                    else:  # a last word alone is no phrase
                        more = places[1] >= 0
                        places, count, ids = [p[more] for p in places], count[more], np.append(ids, 0)
                        columns = {w: ids[p] for w, p in zip(names, places)}
                    yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(count, pa.int64())})

    kind = ", ".join(f"{w} long" for w in [*names, "n"])
    return documents.select("lang", "text").mapInArrow(run, kind if depth > 1 else "lang string, word string, " + kind)


def subtree(rows: pa.Table, least: int) -> pa.Table:
    """The nodes of one group's subtree that ``least`` suffixes or more lie under: (w1, w2, w3 or 0, a)."""
    keys = [rows[w].to_numpy() for w in ("w1", "w2", "w3")]
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], rows["n"].to_numpy()[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    found = []
    for depth in (1, 2):
        new[1:] |= keys[depth][1:] != keys[depth][:-1]
        start = np.flatnonzero(new)
        total = np.add.reduceat(n, start)
        keep = (total >= least) & (keys[depth][start] != 0)
        start, total = start[keep], total[keep]
        found.append([keys[0][start], keys[1][start], keys[2][start] * (depth == 2), total])
    return pa.table(dict(zip(("w1", "w2", "w3", "a"), (np.concatenate(c) for c in zip(*found)))))


def vocabulary(documents: DataFrame, size: int = SLICE) -> tuple[DataFrame, int]:
    """Words (lang, word, w1, a), w1 being their ids, and the seed of the ids: the first one that gives no id twice."""
    seed = 0
    while True:
        words = stored(counted_suffixes(documents, 1, size, seed).groupBy("lang", "word", "w1").agg(F.sum("n").alias("a")))
        if words.groupBy("w1").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def phrase_counts(documents: DataFrame, least: int = LEAST, budget: int = BUDGET, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, w1, a) and phrases of two and three words (w1, w2, w3 or 0, a), the latter from ``least`` occurrences on."""
    words, seed = vocabulary(documents, size)
    groups = max(1, math.ceil((words.agg(F.sum("a")).first()[0] or 0) / (budget // 2)))
    often = stored(words.where(F.col("a") > budget // 4).select("w1", F.lit(True).alias("often")))
    pairs = counted_suffixes(documents, 2, size, seed).join(often, "w1", "left_semi")
    pairs = stored(pairs.groupBy("w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") > budget // 4))
    rows = (counted_suffixes(documents, DEPTH, size, seed).join(often, "w1", "left")
            .join(pairs.select("w1", "w2", F.lit(True).alias("more")), ["w1", "w2"], "left"))
    prefix = ["w1", F.when(F.col("often"), F.col("w2")), F.when(F.col("more"), F.col("w3"))]
    rows = rows.select(F.pmod(F.xxhash64(*prefix), F.lit(groups).cast("long")).alias("group"), "w1", "w2", "w3", "n")
    nodes = rows.groupBy("group").applyInArrow(lambda t: subtree(t, least), "w1 long, w2 long, w3 long, a long")
    # the leaves of a pair that was extended lie in many groups: its count is known, its partial nodes go
    kept = nodes.join(pairs.select("w1", "w2", F.lit(0).cast("long").alias("w3")), ["w1", "w2", "w3"], "left_anti")
    whole = pairs.where(F.col("a") >= least).select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a")
    return words, stored(kept.unionByName(whole))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimals."""
    return F.expr(f"cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))"
                  f" div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, budget: int = BUDGET,
                 size: int = SLICE, parts: tuple = (512, 4)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A pair inside a phrase of three words goes where the longer one has ``cover`` percent of its occurrences or more.
    """
    words, nodes = phrase_counts(documents, least, budget, size)
    known = stored(words.where(F.col("a") >= least))

    def of_word(w, name, *more):
        return known.select(F.col("w1").alias(w), F.col("a").alias(name), F.col("word").alias("t" + w[1]), *more)

    def of_pair(w, v, name):
        return nodes.where("w3 = 0").select(F.col("w1").alias(w), F.col("w2").alias(v), F.col("a").alias(name))

    triples = nodes.where("w3 <> 0")
    longer = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = stored(longer.groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    two = (nodes.where("w3 = 0").join(longer, ["w1", "w2"], "left")
           .where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
           .join(of_word("w1", "l", "lang"), "w1").join(of_word("w2", "r"), "w2")
           .select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", "l", "r", score("a", "l", "r").alias("score")))
    three = (triples.join(of_pair("w2", "w3", "r1"), ["w2", "w3"]).join(of_pair("w1", "w2", "l2"), ["w1", "w2"])
             .join(of_word("w1", "l1", "lang"), "w1").join(of_word("w2", "middle"), "w2").join(of_word("w3", "r2"), "w3")
             .withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")}))
    second = F.col("s2") < F.col("s1")
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
                         F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                         F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = two.unionByName(three)
    for n in (*parts, 1):
        ranked = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every whole text of ``documents``."""
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM t),
c AS (
  SELECT lang, unnest(flatten([
           list_transform(range(1, len(ws) + 1), lambda i: [ws[i]]),
           list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]]),
           list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])])) AS ph
  FROM p),
f AS (SELECT lang, ph, CAST(count(*) AS BIGINT) AS a FROM c GROUP BY lang, ph),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
k AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS cut FROM f WHERE len(ph) > 1 AND a >= 10),
s AS (
  SELECT k.lang, k.ph, k.a, k.cut, x.a AS l, y.a AS r,
         CAST(1000000 * CAST(k.a AS HUGEINT) * k.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.ph = k.ph[:cut] JOIN f y ON y.lang = k.lang AND y.ph = k.ph[cut + 1:]),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) AS place FROM s),
i AS (
  SELECT lang, ph, max(a) AS longer FROM (
    SELECT lang, ph[:2] AS ph, a FROM f WHERE len(ph) = 3 AND a >= 10
    UNION ALL SELECT lang, ph[2:] AS ph, a FROM f WHERE len(ph) = 3 AND a >= 10) GROUP BY lang, ph),
o AS (
  SELECT m.lang, array_to_string(m.ph, ' ') AS phrase, m.a, m.l, m.r, m.score
  FROM m LEFT JOIN i ON i.lang = m.lang AND i.ph = m.ph
  WHERE m.place = 1 AND (i.longer IS NULL OR 100 * i.longer < 50 * m.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
