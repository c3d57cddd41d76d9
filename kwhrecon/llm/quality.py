"""Quality classifier: supervised subword embeddings.

A text is the bag of its words, doubled words and character n-grams, hashed into
``BUCKETS`` learned vectors; the document vector is their mean and a softmax
layer gives the class. Training is plain stochastic gradient descent in numpy
(about ``STEPS`` steps) over a bounded sample: of each class at most ``SAMPLE`` labelled documents, the
first by a hash of their id. Executors turn the sample into hashed counts, so
the driver sees numbers only, at most 2 * ``SAMPLE`` * ``BUCKETS`` of them.

Scoring is one pass without a shuffle. As mean and output layer are linear,
each bucket's vector is first multiplied into its one-number share of the
margin, and a text costs a few array operations per n-gram order.

Edge cases: a null or empty text has no features and gets the score of the
bias alone. Labels of one document that disagree teach nothing. Without labels
of both classes every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, read, with_hash_class

BUCKETS, DIM, GRAMS, SAMPLE, STEPS, RATE, PART = 1 << 17, 16, (2, 3), 1500, 15_000, 0.1, 1 << 20


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 17)).astype(np.int64)


def _part_features(raw: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    code = np.where(space, np.uint8(32), b).astype(np.uint64)
    found = []
    edge = np.flatnonzero(np.diff(space.astype(np.int8)))
    if len(edge):
        first, last = edge[0::2] + 1, edge[1::2] + 1
        powers = np.cumprod(np.full(int((last - first).max()), 0x100000001B3, np.uint64))
        inside = np.flatnonzero(~space)
        start = np.repeat(first, last - first)
        words = np.add.reduceat(code[inside] * powers[inside - start], np.r_[0, np.cumsum(last - first)[:-1]])
        found.append(_mix(words, 1))
        # a word pair of two equal words is one feature, whatever the word
        found.append(np.full(int((words[1:] == words[:-1]).sum()), _mix(np.zeros(1, np.uint64), 99)[0]))
    for n in GRAMS:
        if len(code) < n:
            continue
        h, ok = np.zeros(len(code) - n + 1, np.uint64), np.ones(len(code) - n + 1, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k:len(code) - n + 1 + k]
            if 0 < k < n - 1:
                ok &= ~space[k:len(code) - n + 1 + k]
        found.append(_mix(h[ok], n))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def features(text: str):
    """Buckets of all words and n-grams, with repeats; a very long text comes in parts cut at white space."""
    raw = text.encode("utf-8", "surrogatepass")
    lo = 0
    while lo < len(raw):
        hi = lo + PART
        if hi < len(raw):
            cut = raw.find(b" ", hi)
            hi = len(raw) if cut < 0 else cut
        part = _part_features(raw[lo:hi])
        if len(part):
            yield part
        lo = hi


def _bags(ids: pa.Array, texts: pa.Array, labels: pa.Array) -> dict:
    at, counts = [], []
    for t in texts:
        n = np.zeros(BUCKETS, np.int64)
        for part in features(t.as_py() or ""):
            n += np.bincount(part, minlength=BUCKETS)
        at.append(np.flatnonzero(n).astype(np.int32))
        counts.append(n[at[-1]].astype(np.int32))
    return {"doc_id": ids, "label": labels, "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(counts, pa.list_(pa.int32()))}


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Per-bucket margin and bias, from (label, buckets, counts) by stochastic gradient descent."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = [(y, at, (n / n.sum()).astype(np.float32)) for y, at, n in bags if len(at)]
    if len({y for y, _, _ in share}) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    epochs = -(-steps // len(share))
    total, done = epochs * len(share), 0
    for _ in range(epochs):
        for i in rng.permutation(len(share)):
            y, at, w = share[i]
            step = rate * (1 - done / total)
            done += 1
            hidden = w @ vectors[at]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= step * np.outer(p, hidden)
            bias -= step * p
            # the mean spreads a step thinly: rows are moved in proportion to their share of the text
            vectors[at] -= (step * len(at) ** 0.5) * w[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from (doc_id, text) and (doc_id, label): at most ``sample`` documents of each class."""
    clean = (labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id")
             .agg(F.min("label").cast("int").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most"))
    chosen = None
    for y in (0, 1):
        part = clean.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * `sample` small rows
    rows = by_document(texts, _bags, "doc_id long, label int, at array<int>, n array<int>", ["doc_id", "text", "label"]).toArrow()
    ids = rows["doc_id"].to_numpy()
    order = np.lexsort((ids,))
    y = rows["label"].to_numpy()
    return fit([(int(y[i]), np.asarray(rows["at"][i].values), np.asarray(rows["n"][i].values)) for i in order])


def _scores(ids: pa.Array, texts: pa.Array, model: tuple[np.ndarray, float]) -> dict:
    margin, bias = model
    out = []
    for t in texts:
        total, n = 0.0, 0
        for part in features(t.as_py() or ""):
            total += float(margin[part].sum(dtype=np.float64))
            n += len(part)
        out.append(round(1 / (1 + np.exp(-np.clip(bias + (total / n if n else 0.0), -50, 50))), 6))
    return {"doc_id": ids, "score": pa.array(out, pa.float64())}


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every whole text."""
    return by_document(documents, _scores, "doc_id long, score double", ["doc_id", "text"], model)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every whole text of ``documents``, learned from ``labels.quality`` outside the held-out third."""
    docs = read(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = with_hash_class(read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), F.col("quality").alias("label")))
    found = score(docs, learn(docs, labels.where("_crc % 3 <> 1").select("doc_id", "label")))
    return (with_hash_class(found).withColumn("held_out", F.col("_crc") % 3 == 1)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
