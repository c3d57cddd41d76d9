"""Substring dedup: matching statistics against compressed FM-indexes per shard.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash among its
runs of ``GRAM`` words, so equal windows have equal anchors, and neighbouring
windows mostly share theirs: a document falls into segments, the stretches of
text whose windows share an anchor.

1. Each document's segments are listed as hashes. Anchors of one document only
   (by a partial aggregate) are done.
2. Segments with equal content are one class, held by its least document; in
   every larger document all of its words go.
3. Classes that share an anchor may still share windows. They are dealt out by
   anchor; each shard of about ``SHARD`` words is indexed (suffix order, wavelet
   matrix), and its segments are streamed through backward search, which reports
   the intervals of at least ``WINDOW`` words that a smaller document has.
4. An anchor with more than ``HOT`` classes would outgrow a shard. Its windows are
   hashed one by one instead and aggregated to their least document (exact too,
   and combined before the shuffle, whatever their number).

Words to be removed are the union over all windows; they are judged on the
input, not on what is left. Documents without a shared anchor ship no text.

Edge cases: null, empty and short texts have no windows and lose nothing. Rows
that repeat an id never remove each other's words; each gets a row, and texts
that differ are cut each by its own windows (a row is known by its id and the
hash of its text). Rows without an id are neither smaller nor larger than others:
they lose nothing and hold nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, grouped, read, stored
from .fmindex import FMIndex, matched_windows
from .words import mix, windows, word_bounds, word_hashes

WINDOW, GRAM, SHARD, HOT = 50, 8, 1 << 19, 4096


def segments(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content hash, first window, number of windows) of the word hashes of a text."""
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none, none
    gram = windows(h, GRAM)
    span = WINDOW - GRAM + 1
    at = np.concatenate([np.lib.stride_tricks.sliding_window_view(gram[lo:lo + (1 << 16) + span - 1], span).argmin(1) + lo + np.arange(
        min(1 << 16, len(gram) - span + 1 - lo)) for lo in range(0, len(gram) - span + 1, 1 << 16)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    # content: a polynomial over the segment's words, from running sums of word * power and the inverse power
    p = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(len(h), p, np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(mix(h) * power)]
    inverse = np.uint64(pow(int(p), -1, 2**64))
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(h) - 1, inverse, np.uint64)])
    content = (total[first + count + WINDOW - 1] - total[first]) * back[first]
    content = mix(content ^ mix((at[first] - first).astype(np.uint64) * np.uint64(1000) + count.astype(np.uint64)))
    return gram[at[first]].view(np.int64), content.view(np.int64), first, count


def _raw(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def kept_digest(raw: bytes, gone: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by spaces); ``gone`` are ranges of words."""
    words = raw.split()  # bytes split at space and the controls 9 to 13
    if not gone:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [a for a, _ in gone], 1)
    np.add.at(change, [min(b, len(words)) for _, b in gone], -1)
    rows = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
    return len(words), len(words) - len(rows), b" ".join([words[i] for i in rows])


def _segment_rows(ids: pa.Array, hashes: pa.Array, texts: pa.Array) -> dict:
    """Per document one row of its segments, and its digest in case nothing is removed."""
    rows, sizes, shas = [], [], []
    for t in texts:
        raw = _raw(t)
        rows.append(segments(word_hashes(raw)))
        n, _, kept = kept_digest(raw, [])
        sizes.append(n)
        shas.append(hashlib.sha256(kept).hexdigest())
    offsets = np.r_[0, np.cumsum([len(r[0]) for r in rows])].astype(np.int32)
    parts = [np.concatenate([r[k] for r in rows]) for k in range(4)]
    struct = pa.StructArray.from_arrays([pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))],
                                        names=["anchor", "seg", "start", "n"])
    return {"doc_id": ids, "h": hashes, "n_words": pa.array(sizes, pa.int64()), "sha": shas,
            "segments": pa.ListArray.from_arrays(pa.array(offsets), struct)}


def _cut(ids: pa.Array, texts: pa.Array, wanted: pa.Array) -> dict:
    """The texts of wanted segments (anchor, seg, start, n)."""
    out: dict[str, list] = {"anchor": [], "seg": [], "doc_id": [], "n": [], "words": []}
    for i, t, segs in zip(ids.to_pylist(), texts, wanted):
        raw = _raw(t)
        _, first, after = word_bounds(raw)
        for s in segs.as_py():
            last = s["start"] + s["n"] + WINDOW - 2
            if last < len(after):
                for k, v in zip(out, (s["anchor"], s["seg"], i, s["n"], raw[first[s["start"]]:after[last]])):
                    out[k].append(v)
    return {k: pa.array(v, pa.binary() if k == "words" else pa.int64()) for k, v in out.items()}


def _search(anchor: list, seg: list, owner: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
    """Index one shard and stream its segments through it."""
    # numbers from 1 on in order of the hashes; 0 ends a segment
    flat = np.concatenate([np.r_[w, np.uint64(0)] for w in words])
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    values, text = np.unique(np.delete(flat, ends), return_inverse=True)
    symbols = np.zeros(len(flat), np.int64)
    symbols[np.delete(np.arange(len(flat)), ends)] = text + 1
    length = np.array([len(w) for w in words], np.int64)
    start = ends - length
    index = FMIndex(symbols, len(values) + 1, np.repeat(owner, length + 1))
    found = matched_windows(index, symbols, start, length, owner, WINDOW)
    lane, a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    return pa.RecordBatch.from_pydict({"anchor": np.array(anchor, np.int64)[lane], "seg": np.array(seg, np.int64)[lane],
                                       "a": a.astype(np.int32), "b": b.astype(np.int32)})


def _shards(batches):
    """Gather whole anchors up to a shard, then search it."""
    held: list[tuple] = []
    size = 0
    for table, offsets in grouped(batches, ["anchor"]):
        anchor, seg, owner = (table[c].to_numpy() for c in ("anchor", "seg", "doc_id"))
        words = table["words"].combine_chunks() if isinstance(table["words"], pa.ChunkedArray) else table["words"]
        for lo, hi in itertools.pairwise(offsets):
            for i in range(lo, hi):
                w = word_hashes(words[i].as_py())
                held.append((anchor[i], seg[i], owner[i], w))
                size += len(w) + 1
            if size >= SHARD:
                yield _search([x[0] for x in held], [x[1] for x in held], np.array([x[2] for x in held], np.int64), [x[3] for x in held])
                held, size = [], 0
    if held:
        yield _search([x[0] for x in held], [x[1] for x in held], np.array([x[2] for x in held], np.int64), [x[3] for x in held])


def _window_rows(anchor: pa.Array, seg: pa.Array, ids: pa.Array, words: pa.Array) -> dict:
    parts = [windows(word_hashes(w.as_py()), WINDOW).view(np.int64) for w in words]
    size = [len(p) for p in parts]
    return {"anchor": np.repeat(anchor.to_numpy(), size), "seg": np.repeat(seg.to_numpy(), size), "doc_id": np.repeat(ids.to_numpy(), size),
            "a": np.concatenate([np.arange(n, dtype=np.int32) for n in size]), "hash": np.concatenate(parts)}


def repeated_ranges(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, h, gone: list of word ranges), texts of the documents concerned, digest rows of all documents); h is the text's hash."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    schema = "doc_id long, h long, n_words long, sha string, segments array<struct<anchor:long,seg:long,start:int,n:int>>"
    listed = stored(by_document(docs, _segment_rows, schema, ["doc_id", "h", "text"]))
    rows = listed.where("doc_id is not null").select("doc_id", "h", F.inline("segments"))
    shared = stored(rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"))
    met = stored(rows.join(shared, "anchor"))
    classes = stored(met.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "h", "start", "n")).alias("own"))
                     .select("anchor", "seg", F.col("own.doc_id").alias("first"), F.col("own.h").alias("first_h"), "own.start", "own.n"))
    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("first").alias("lo"), F.max("first").alias("hi"))
                     .where("lo < hi").select("anchor", (F.col("k") > HOT).alias("hot")))
    held = stored(met.join(classes.select("anchor", "seg", "first"), ["anchor", "seg"]))
    whole = held.where("doc_id > first").select("doc_id", "h", F.col("start").alias("from"), (F.col("start") + F.col("n") + (WINDOW - 1)).alias("to"))
    wanted = (classes.join(several, "anchor").groupBy(F.col("first").alias("doc_id"), F.col("first_h").alias("h"))
              .agg(F.collect_list(F.struct("anchor", "seg", "start", "n")).alias("wanted")))  # the segments of one document
    concerned = stored(whole.select("doc_id", "h").unionByName(wanted.select("doc_id", "h")).distinct())
    # the side of the ids grows with the documents: merged at every size, not broadcast while it is small
    texts = stored(docs.hint("merge").join(concerned, ["doc_id", "h"], "left_semi"))
    cut = stored(by_document(texts.join(wanted, ["doc_id", "h"]), _cut, "anchor long, seg long, doc_id long, n long, words binary",
                             ["doc_id", "text", "wanted"]).dropDuplicates(["anchor", "seg"]).join(several, "anchor"))
    cold = (cut.where("not hot").select("anchor", "seg", "doc_id", "words").repartition("anchor")
            .sortWithinPartitions("anchor", "doc_id", "seg").mapInArrow(_shards, "anchor long, seg long, a int, b int"))
    hot = stored(by_document(cut.where("hot"), _window_rows, "anchor long, seg long, doc_id long, a int, hash long",
                             ["anchor", "seg", "doc_id", "words"]))
    least = stored(hot.groupBy("anchor", "hash").agg(F.min("doc_id").alias("least")))
    one_by_one = hot.join(least, ["anchor", "hash"]).where("least < doc_id").select("anchor", "seg", "a", F.col("a").alias("b"))
    parts = stored(cold.unionByName(one_by_one))
    partial = (held.where("doc_id = first").join(parts, ["anchor", "seg"])
               .select("doc_id", "h", (F.col("start") + F.col("a")).alias("from"), (F.col("start") + F.col("b") + WINDOW).alias("to")))
    gone = stored(whole.unionByName(partial).groupBy("doc_id", "h").agg(F.collect_list(F.struct("from", "to")).alias("gone")))
    return gone, texts, listed.select("doc_id", "h", "n_words", "sha")


def _digests(ids: pa.Array, texts: pa.Array, gone: pa.Array) -> dict:
    rows = [kept_digest(_raw(t), [(g["from"], g["to"]) for g in ranges.as_py()]) for t, ranges in zip(texts, gone)]
    return {"doc_id": ids, "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()),
            "kept_sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows]}


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of (doc_id, text)."""
    gone, texts, listed = repeated_ranges(documents)
    cut = by_document(texts.join(gone, ["doc_id", "h"]), _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string",
                      ["doc_id", "text", "gone"])
    same = (listed.join(gone.select("doc_id", "h"), ["doc_id", "h"], "left_anti")
            .select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))
    return cut.unionByName(same)


def _rewrite(ids: pa.Array, hashes: pa.Array, texts: pa.Array, gone: pa.Array) -> dict:
    kept = [kept_digest(_raw(t), [(g["from"], g["to"]) for g in ranges.as_py()])[2].decode("utf-8", "surrogatepass")
            for t, ranges in zip(texts, gone)]
    return {"doc_id": ids, "h": hashes, "text": pa.array(kept, pa.string())}


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with repeated windows cut out; a document that loses all of its words goes.

    Documents that lose nothing keep their text as it is; of the others the
    kept words are joined by single spaces.
    """
    gone, texts, _ = repeated_ranges(documents)
    cut = stored(by_document(texts.join(gone, ["doc_id", "h"]), _rewrite, "doc_id long, h long, text string", ["doc_id", "h", "text", "gone"]))
    new = cut.select("doc_id", "h", F.col("text").alias("_kept")).dropDuplicates(["doc_id", "h"])
    packed = documents.select("doc_id", F.xxhash64("text").alias("h"), F.struct("*").alias("_row")).hint("merge").join(new, ["doc_id", "h"], "left").where("_kept is null or _kept <> ''")
    return packed.select(F.col("_row").withField("text", F.coalesce("_kept", "_row.text")).alias("_row")).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every whole text of ``documents``."""
    return digests(read(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
low AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
hit AS (SELECT DISTINCT win.doc_id, win.i FROM win JOIN low USING (h) WHERE lo < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.p) AS t FROM p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
