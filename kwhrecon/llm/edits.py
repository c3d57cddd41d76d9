"""Token counts that follow edits: a segment tree of pre-tokens per document.

The leaves of a document's tree hold runs of pre-tokens with their token
counts; inner nodes hold the sums of characters and tokens below them. An edit
descends by characters to the leaf it touches, re-splits and re-encodes from
the last pre-token that the edit can reach (``HOLD`` characters before it) to
the first border that old and new text share, and updates the sums on the way
up. All other pre-tokens keep their counts.

Trees are kept: ``token_trees`` gives each document its tree, as the sums of its
leaves (the inner sums follow from them), in rows to be stored. ``apply_edits``
takes stored trees with a list of edits each (``with_edits`` joins them from a
table) and gives the trees after the edits; only the leaves that an edit reaches
are split and encoded again, so a later batch of edits costs what it touches.

Scale: trees are built where the documents lie, without a shuffle; edits are one
row per document in the same table, so they need none either. Leaf sums are some
eight bytes for ``LEAF`` pre-tokens. A task holds one document's tree besides the
tokenizer tables and bounded caches; a lost task is run again from the stored trees.

Edge cases: a null text is an empty one, with a tree of one empty leaf; a very
long text has a large tree, nothing else. Edits apply in order to the text that
the edits before them left; positions are characters, cut to the text's ends;
null edits or null fields count as none, 0 and the empty string. Strings of
special tokens count as ordinary text, or with ``special`` as their ids do in
encoding. Repeated rows are rows of their own; there are no ties. An empty table
gives no rows.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import HOLD, SHORT, Encoder, Recent, default_path, load
from .common import read, stored

LEAF = 32
EDITS = "array<struct<start:int,length:int,insert:string>>"

#: Personal data and secrets to redact, and what stands in their place.
REDACT = [
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b(?=[a-f]*[0-9])[0-9a-f]{32,64}\b", "<secret>"),
    (r"\+\d{1,2} ?\(\d{3}\) ?\d{3}-\d{4}", "<phone>"),
    (r"\b\d{13,16}\b", "<number>"),
]


#: Every kind has a digit or an at sign (a hexadecimal secret without a digit is a word). Digits of any script count, as in REDACT.
SIGNS, OTHER_SIGNS = re.compile("[0-9@]"), regex.compile(r"\d")


def signs(text: str) -> bool:
    """Whether the text may have anything to redact."""
    return bool(SIGNS.search(text) or not text.isascii() and OTHER_SIGNS.search(text))


class Counts(Recent):
    """Tokens of each pre-token; short ones are remembered. With ``special`` the strings of special tokens are one token."""

    def __init__(self, encoder: Encoder, special: bool = False):
        super().__init__(lambda piece: len(encoder.ids(piece)))
        self.encoder, self.special = encoder, encoder.special if special else {}
        self.names = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: characters before and after a border that can move it
        self.reach = max([HOLD, *map(len, self.special)])

    def __missing__(self, piece: str) -> int:
        if piece in self.special:
            return 1
        return super().__missing__(piece) if len(piece) <= SHORT else self.make(piece)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens end what stands before them."""
        find = self.encoder.split.findall
        if not self.names or not any(s in text for s in self.special):
            return find(text)
        return [p for i, part in enumerate(self.names.split(text)) for p in ([part] if i % 2 else find(part))]

    def leaf_sums(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each run of ``LEAF`` pre-tokens."""
        n = len(pieces)
        if not n:
            return np.zeros(1, np.int32), np.zeros(1, np.int32)
        chars, tokens = np.fromiter(map(len, pieces), np.int32, n), np.fromiter(map(self.__getitem__, pieces), np.int32, n)
        start = np.arange(0, n, LEAF)
        return np.add.reduceat(chars, start), np.add.reduceat(tokens, start)


class TokenTree:
    """The token count of one text under edits."""

    def __init__(self, pieces: list[str], encoder: Encoder, counts: Counts):
        self.encoder, self.counts = encoder, counts
        self.encoded = len(pieces)
        rows = list(zip(pieces, map(counts.__getitem__, pieces)))
        self._build([rows[i:i + LEAF] for i in range(0, len(rows), LEAF)] or [[]])

    @classmethod
    def kept(cls, text: str, chars: list[int], tokens: list[int], counts: Counts) -> TokenTree:
        """The tree of a text from its stored leaf sums; a leaf is text until an edit opens it."""
        tree = cls.__new__(cls)
        tree.encoder, tree.counts, tree.encoded = counts.encoder, counts, 0
        ends = list(itertools.accumulate(chars))
        tree._build([text[e - n:e] for e, n in zip(ends, chars)], chars, tokens)
        return tree

    def sums(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold text."""
        both = [(c, t) for c, t in zip(self.chars[self.size:], self.tokens[self.size:]) if c] or [(0, 0)]
        return [c for c, _ in both], [t for _, t in both]

    def _ahead(self, i: int, n: int) -> str:
        """The first ``n`` characters after a leaf."""
        found = ""
        while len(found) < n and (i := i + 1) < self.size:
            leaf = self.leaves[i]
            found += leaf[:n] if isinstance(leaf, str) else "".join(p for p, _ in leaf)
        return found[:n]

    def _rows(self, i: int) -> list[tuple[str, int]]:
        """The pre-tokens of a leaf with their counts; a leaf that is text is split with what follows in sight."""
        leaf = self.leaves[i]
        if isinstance(leaf, str):
            found, left = [], len(leaf)
            for p in self.counts.split(leaf + self._ahead(i, self.counts.reach)):
                if left <= 0:
                    break
                found.append(p)
                left -= len(p)
            self.leaves[i] = list(zip(found, map(self.counts.__getitem__, found)))
        return self.leaves[i]

    def _build(self, leaves: list, chars=None, tokens=None) -> None:
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.leaves = leaves + [[] for _ in range(self.size - len(leaves))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(leaves):
            self.chars[self.size + i] = chars[i] if chars is not None else sum(len(p) for p, _ in leaf)
            self.tokens[self.size + i] = tokens[i] if tokens is not None else sum(n for _, n in leaf)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(leaf if isinstance(leaf, str) else "".join(p for p, _ in leaf) for leaf in self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character, and the characters before that leaf."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if position - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` on by ``insert``."""
        start = min(max(start, 0), self.n_chars)
        end = min(start + max(length, 0), self.n_chars)
        hold = self.counts.reach
        first, before = self._leaf_at(max(0, start - hold))
        last, _ = self._leaf_at(end)
        pieces = [x for i in range(first, last + 1) for x in self._rows(i)]
        # what comes before the touched part keeps its counts
        kept, at = [], before
        while pieces and at + len(pieces[0][0]) <= start - hold + 1:
            at += len(pieces[0][0])
            kept.append(pieces.pop(0))
        while True:
            old = "".join(p for p, _ in pieces)
            new = old[: start - at] + insert + old[end - at:]
            ended = last >= self.size - 1 or not any(self.chars[self.size + last + 1:])
            shift, border = len(new) - len(old), at
            borders = set()
            for p, _ in pieces:
                border += len(p)
                if border >= end:
                    borders.add(border - at + shift)
            found, done, safe = [], 0, len(new) if ended else len(new) - hold
            for p in self.counts.split(new):
                if done in borders or done + len(p) > safe:
                    break
                found.append(p)
                done += len(p)
            if done in borders or ended and done == len(new):
                break
            step = max(1, last + 1 - first)
            pieces += [x for i in range(last + 1, min(self.size, last + 1 + step)) for x in self._rows(i)]
            last = min(self.size - 1, last + step)
        self.encoded += len(found)
        rest, border = [], at
        for p, n in pieces:
            border += len(p)
            if border - len(p) - at + shift >= done and border > end:
                rest.append((p, n))
        self._replace(first, last, kept + [(p, self.counts[p]) for p in found] + rest)

    def _replace(self, first: int, last: int, rows: list[tuple[str, int]]) -> None:
        """New contents of some leaves; sums change on their paths to the root. An overfull leaf regrows the tree."""
        n = last + 1 - first
        if len(rows) > 4 * LEAF * n:
            cut = [rows[i:i + LEAF] for i in range(0, len(rows), LEAF)]
            keep = [i for i in (*range(first), *range(last + 1, self.size)) if self.chars[self.size + i]]
            place = sum(i < first for i in keep)
            leaves = [self.leaves[i] for i in keep]
            chars, tokens = [self.chars[self.size + i] for i in keep], [self.tokens[self.size + i] for i in keep]
            leaves[place:place], chars[place:place] = cut, [sum(len(p) for p, _ in leaf) for leaf in cut]
            tokens[place:place] = [sum(n for _, n in leaf) for leaf in cut]
            self._build(leaves, chars, tokens)
            return
        each = -(-len(rows) // n) if rows else 1
        touched = set()
        for k in range(n):
            i = self.size + first + k
            leaf = self.leaves[first + k] = rows[k * each:(k + 1) * each]
            self.chars[i], self.tokens[i] = sum(len(p) for p, _ in leaf), sum(c for _, c in leaf)
            touched.add(i // 2)
        while touched and 0 not in touched:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched}


TREE = "doc_id long, n_tokens long, n_pieces long, chars array<int>, tokens array<int>, text string, edits " + EDITS
_EDIT = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("insert", pa.string())]))


def _counts_of(state: dict) -> Counts:
    if "counts" not in state:
        state["counts"] = Counts(Encoder(state["tables"]), state["special"])
    return state["counts"]


def token_trees(documents: DataFrame, path: str, special: bool = False, find=None, keep_texts: bool = False) -> DataFrame:
    """The tree of every row (doc_id, text[, edits]): ``TREE``. Edits come with the row, or from ``find`` (text -> edits).

    The text stays with the trees that have edits, or with all (``keep_texts``).
    """
    state = {"tables": load(path), "special": special}
    given = "edits" in documents.columns

    def run(batches):
        counts = _counts_of(state)
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "n_pieces": [], "chars": [], "tokens": [], "text": [], "edits": []}
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                pieces = counts.split(text)
                chars, tokens = counts.leaf_sums(pieces)
                edits = [e for e in batch.column(2)[i].as_py() or [] if e] if given else find(text) if find else []
                for k, v in zip(out, (int(tokens.sum()), len(pieces), chars, tokens, text if edits or keep_texts else None, edits)):
                    out[k].append(v)
            kinds = {"chars": pa.list_(pa.int32()), "tokens": pa.list_(pa.int32()), "text": pa.string(), "edits": _EDIT}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return documents.select("doc_id", "text", *(["edits"] if given else [])).mapInArrow(run, TREE)


def apply_edits(trees: DataFrame, path: str, special: bool = False) -> DataFrame:
    """Trees (with texts) after their edits: ``TREE`` without edits left, n_before (tokens), n_edits, and n_reencoded,
    the pre-tokens that were split and encoded again."""
    state = {"tables": load(path), "special": special}

    def run(batches):
        counts = _counts_of(state)
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "n_pieces": [], "chars": [], "tokens": [], "text": [], "edits": [],
                                    "n_before": [], "n_edits": [], "n_reencoded": []}
            for row in batch.to_pylist():
                edits = [e for e in row["edits"] or [] if e]
                tree = TokenTree.kept(row["text"] or "", row["chars"], row["tokens"], counts)
                for e in edits:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                chars, tokens = tree.sums()
                for k, v in zip(out, (tree.n_tokens, row["n_pieces"], chars, tokens, tree.text(), [], row["n_tokens"], len(edits), tree.encoded)):
                    out[k].append(v)
            kinds = {"chars": pa.list_(pa.int32()), "tokens": pa.list_(pa.int32()), "text": pa.string(), "edits": _EDIT}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    columns = ["doc_id", "n_tokens", "n_pieces", "chars", "tokens", "text", "edits"]
    return trees.select(*columns).mapInArrow(run, TREE + ", n_before long, n_edits long, n_reencoded long")


def counts_after(trees: DataFrame, path: str, special: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_pieces, n_reencoded) of stored trees under their edits."""
    zero = F.lit(0).cast("long")
    still = trees.where(F.size("edits") == 0).select("doc_id", "n_tokens", zero.alias("n_edits"), F.col("n_tokens").alias("n_tokens_edited"), "n_pieces", zero.alias("n_reencoded"))
    moved = apply_edits(trees.where(F.size("edits") > 0), path, special).select(
        "doc_id", F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_pieces", "n_reencoded")
    return still.unionByName(moved)


def count_edited(documents: DataFrame, path: str, special: bool = False) -> DataFrame:
    """Token counts before and after the edits of rows (doc_id, text, edits); see ``EDITS`` for the type."""
    return counts_after(stored(token_trees(documents, path, special)), path, special)


def with_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents (or stored trees) with their edits from a table (doc_id, seq, start, length, insert), in order of seq."""
    lists = edits.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "start", "length", "insert"))),
        lambda e: F.struct(e["start"].cast("int").alias("start"), e["length"].cast("int").alias("length"),
                           e["insert"].alias("insert"))).alias("edits"))
    return documents.drop("edits").join(lists, "doc_id", "left").select(*[c for c in documents.columns if c != "edits"], "edits")


def redactions(text: str) -> list[dict]:
    """Edits that put placeholders in place of personal data and secrets, last one first so that positions hold."""
    if not signs(text):
        return []
    any_ = regex.compile("|".join(f"(?P<k{i}>{p})" for i, (p, _) in enumerate(REDACT)))
    found = [{"start": m.start(), "length": m.end() - m.start(), "insert": REDACT[int(m.lastgroup[1:])][1]}
             for m in any_.finditer(text)]
    return found[::-1]


def with_redactions(documents: DataFrame) -> DataFrame:
    """Documents with the edits that redact them."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": batch.column(1),
                                              "edits": pa.array([redactions(t.as_py() or "") for t in batch.column(1)], _EDIT)})

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id long, text string, edits {EDITS}")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the trees of all ``documents``, stored, and their counts under the edits that redact them; special tokens count as in op2."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    trees = stored(token_trees(docs, default_path(), special=True, find=redactions))
    return counts_after(trees, default_path(), special=True)
