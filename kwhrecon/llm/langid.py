"""Language ID: script ranges, per-word scores, Viterbi with a switching penalty.

The model is a table of log probabilities of hashed letter trigrams (word
borders included) per language, and the scripts each language is written in.
A word's script narrows the candidate languages; its score in a language is the
sum over its trigrams. Viterbi over the words of a text, where each change of
language costs ``SWITCH``, labels spans; the language with the most letters wins
the document and its share of the letters is the score.

Learning counts trigrams of a sample of at most ``SAMPLE`` labelled documents
of each language (the first by a hash of their id) with a partial aggregate; the
counts are bounded by languages x ``BUCKETS``, whatever the input. Labelling is one pass
without a shuffle: documents of a batch advance through Viterbi side by side,
as many as hold ``LETTERS`` characters together, so memory is bounded by that and
the longest text.

Edge cases: a null text or one without letters is ``und`` with score 0; a null id
is an id like any other, but teaches nothing. A very long text is labelled whole,
alone in its lane. Words in scripts of no learned language score alike for all.
Ties go to the first language in alphabetical order. With nothing to learn from,
every text is ``und``; an empty table gives no rows. Repeated rows get equal
results; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_document, read, stored, with_hash_class

SAMPLE, BUCKETS, SWITCH, LANES, LETTERS = 4000, 1 << 16, 12.0, 2048, 1 << 21

#: First code point of each script's ranges, and the script (0: none).
SCRIPT_RANGES = [
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
    (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0),
    (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1),
    (0xFB07, 0), (0xFF21, 1), (0xFF5B, 0), (0x20000, 14), (0x32000, 0),
]
SCRIPTS = 15


def letter_kinds() -> np.ndarray:
    """Per code point: 0 no part of words, 1 mark, 2 letter."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x20000):
        name = unicodedata.category(chr(c))
        kinds[c] = 2 if name[0] == "L" else 1 if name[0] == "M" else 0
    kinds[0x20000:0x32000] = 2
    return kinds


#: A plain table that travels with the functions that use it: workers need no copy of this package.
KINDS = letter_kinds()


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of letters: (trigram buckets, first trigram of each word, letters, script)."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = KINDS[code]
    inside = kind > 0
    code = np.where(inside, code, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(inside)
    if not (kind == 2).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F)
         + code[at + 1] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(~inside[at - 1])
    letters = np.add.reduceat((kind[at] == 2).astype(np.int64), first)
    starts = np.array([s for s, _ in SCRIPT_RANGES])
    script = np.array([s for _, s in SCRIPT_RANGES])[np.searchsorted(starts, code[at[first]].astype(np.int64), side="right") - 1]
    return bucket, first, letters, script


def _counts(langs: pa.Array, texts: pa.Array) -> dict:
    """Trigram counts and letters by script (as buckets below zero) of each language in a batch."""
    total: dict[str, np.ndarray] = {}
    for lang, text in zip(langs, texts):
        bucket, first, letters, script = words_of(text.as_py() or "")
        row = total.setdefault(lang.as_py(), np.zeros(BUCKETS + SCRIPTS, np.int64))
        row[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        row[BUCKETS:] += np.bincount(script, weights=letters, minlength=SCRIPTS).astype(np.int64)
    out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
    for lang, row in total.items():
        at = np.flatnonzero(row)
        out["lang"] += [lang] * len(at)
        out["bucket"] += at.tolist()
        out["n"] += row[at].tolist()
    return {"lang": pa.array(out["lang"], pa.string()), "bucket": pa.array(out["bucket"], pa.int32()),
            "n": pa.array(out["n"], pa.int64())}


def teachers(usable: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang): of each language the first ``sample`` ids by their hash.

    A language with many ids is cut by its hash to about twice the sample
    before its ids are ranked, so no task ranks more than that.
    """
    ids = stored(usable.where("doc_id is not null").select("doc_id", "lang").distinct())
    size = ids.groupBy("lang").agg(F.count("*").alias("n"))  # one row per language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    near = (ids.withColumn("_share", share).join(F.broadcast(size), "lang")
            .where(F.col("_share") * F.col("n") <= 2 * sample + 100))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_share", "doc_id"))
    return stored(near.withColumn("_rank", rank).where(F.col("_rank") <= sample).select("doc_id", "lang"))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from rows (doc_id, text, lang); rows without a language teach nothing."""
    usable = labelled.where("lang is not null and text is not null")
    chosen = usable.join(F.broadcast(teachers(usable, sample)), ["doc_id", "lang"], "left_semi")  # at most `sample` ids a language
    counts = (by_document(chosen, _counts, "lang string, bucket int, n long", ["lang", "text"])
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((BUCKETS + SCRIPTS, len(names)))
    for lang, bucket, n in zip(*(counts[c].to_pylist() for c in ("lang", "bucket", "n"))):
        table[bucket, names.index(lang)] = n
    seen, written = table[:BUCKETS] + 0.5, table[BUCKETS:]
    share = written / np.maximum(written.sum(0), 1)
    allowed = share >= 0.01
    allowed[~allowed.any(1)] = True  # a script of no language: no evidence, no language excluded
    return {"names": names, "logp": np.log(seen / seen.sum(0)).astype(np.float32), "allowed": allowed,
            "known": (share >= 0.01).any(1)}


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word; texts (rows starts[i] to starts[i] + lengths[i]) advance side by side."""
    path = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    if not len(order) or lengths[0] == 0:
        return path
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
    came = np.empty(scores.shape, np.int32)
    best = np.zeros((len(order), scores.shape[1]), np.float64)
    stay = np.arange(scores.shape[1], dtype=np.int32)
    for t in range(lengths[0]):
        n = active[t]
        rows, now = starts[:n] + t, best[:n]
        top = now.argmax(1)
        jump = now[np.arange(n), top] - switch
        moved = jump[:, None] > now
        came[rows] = np.where(moved, top[:, None].astype(np.int32), stay)
        best[:n] = np.maximum(now, jump[:, None]) + scores[rows]
    state = best.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        path[rows] = state[:n]
        state[:n] = came[rows, state[:n]]
    return path


def label_words(texts: list[str], model: dict, switch: float = SWITCH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(language number, letters) of each word of each text."""
    n = len(model["names"])
    scores, sizes, weights = [], [], []
    for text in texts:
        bucket, first, letters, script = words_of(text)
        if len(first):
            s = np.add.reduceat(model["logp"][bucket], first, axis=0)
            s = np.where(model["known"][script][:, None], s, 0)
            scores.append(np.where(model["allowed"][script], s, np.float32(-1e4)))
        sizes.append(len(first))
        weights.append(letters)
    lengths = np.array(sizes, np.int64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    path = viterbi(np.concatenate(scores) if scores else np.zeros((0, n), np.float32), starts, lengths, switch)
    return [(path[s:s + k], w) for s, k, w in zip(starts, lengths, weights)]


def lanes(texts: pa.Array) -> Iterator[list[str]]:
    """Texts to advance side by side: at most ``LANES``, and of ``LETTERS`` characters together unless one alone has more."""
    held: list[str] = []
    size = 0
    for t in texts:
        text = t.as_py() or ""
        if held and (len(held) == LANES or size + len(text) > LETTERS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _predict(ids: pa.Array, texts: pa.Array, model: dict) -> dict:
    langs, scores, spans = [], [], []
    for part in lanes(texts):
        if not model["names"]:
            labelled = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(part)
        else:
            labelled = label_words(part, model)
        for path, letters in labelled:
            share = np.bincount(path, weights=letters, minlength=max(1, len(model["names"])))
            total = share.sum()
            langs.append(model["names"][int(share.argmax())] if total else "und")
            scores.append(round(float(share.max() / total), 6) if total else 0.0)
            spans.append(int((path[1:] != path[:-1]).sum() + 1) if len(path) else 0)
    return {"doc_id": ids, "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()),
            "n_spans": pa.array(spans, pa.int32())}


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) of every whole text."""
    return by_document(documents, _predict, "doc_id long, lang_pred string, score double, n_spans int",
                       ["doc_id", "text"], model)


def accepted(documents: DataFrame, model: dict, least: float = 1 / 3) -> DataFrame:
    """The rows, with all of their columns, whose text has a language with at least the given score.

    An empty model knows no language; the rows whose text has letters stay.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows and not model["names"]:
                yield batch.filter(pa.array([len(words_of(t.as_py() or "")[1]) > 0 for t in batch.column("text")]))
            elif batch.num_rows:
                found = _predict(batch.column("doc_id"), batch.column("text"), model)
                good = [lang != "und" and score >= least for lang, score in zip(found["lang_pred"].to_pylist(), found["score"].to_pylist())]
                yield batch.filter(pa.array(good))

    return documents.mapInArrow(run, documents.schema)


def spans(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, first_word, last_word, lang): the labelled spans; words are runs of letters, from 0."""

    def work(ids, texts, model):
        out: dict[str, list] = {"doc_id": [], "first_word": [], "last_word": [], "lang": []}
        for i, (path, _) in zip(ids.to_pylist(), itertools.chain.from_iterable(label_words(part, model) for part in lanes(texts))):
            cut = np.r_[0, np.flatnonzero(path[1:] != path[:-1]) + 1, len(path)] if len(path) else np.zeros(1, int)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                for k, v in zip(out, (i, a, b - 1, model["names"][path[a]])):
                    out[k].append(v)
        return {k: pa.array(v, pa.string() if k == "lang" else pa.int64()) for k, v in out.items()}

    return by_document(documents, work, "doc_id long, first_word long, last_word long, lang string",
                       ["doc_id", "text"], model)


def learning_rows(documents: DataFrame) -> DataFrame:
    """Rows that may teach: crc32 of the id as text, modulo 4, is not 2."""
    return with_hash_class(documents).where("_crc % 4 <> 2").select("doc_id", "text", "lang")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every whole text of ``documents``."""
    docs = read(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = identify(docs, learn(learning_rows(docs)))
    held = with_hash_class(found).withColumn("held_out", F.col("_crc") % 4 == 2)
    return held.select("doc_id", "held_out", "lang_pred", "score", "n_spans")
