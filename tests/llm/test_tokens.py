"""Tokenizer transducers and edit-aware counts against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kwhrecon.llm import bpe, edits

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TABLES = bpe.load(PATH)
ENCODER = bpe.Encoder(TABLES)
PIECES = ["a", "b", "'", "s", "re", " ", "  ", "\n", "1", "é", "日", "<|endoftext|>", "<|endof", "the", "ing", "!", "--", "　", "\x1c", "\x85", "'ll"]


def ids_of(text, size=bpe.CHUNK):
    return [i for entries in ENCODER.encode(bpe.chunks_of(text, size)) for some, _ in entries for i in some]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.integers(1, 40))
def test_any_text_in_any_chunks(text, size):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(text, size) == want
    decoder = bpe.Decoder(TABLES)
    assert decoder.feed(want) + decoder.end() == LIBRARY.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("chunk", [50, 1 << 16])
def test_open_pieces(monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(PIECES) * rng.choice([1, 1, 2, 7, 90]) for _ in range(rng.randint(0, 25)))
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        for size in (1, 17, 1000):
            assert ids_of(text, size) == want


def test_lookahead_is_enough(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(ENCODER, "window", ENCODER.lookahead + 130)
    for _ in range(25):
        text = "".join(rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(3000)) + rng.choice(["ing", "-", "th"]) * 300
        assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_code_point():
    for lo in range(0, 0x3500, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b" for c in range(lo, lo + 64))
        assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ill_formed_ids_decode_as_the_library_does():
    rng = random.Random(6)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        decoder = bpe.Decoder(TABLES)
        got = "".join([decoder.feed([i]) for i in ids]) + decoder.end()
        assert got == LIBRARY.decode(ids, skip_special_tokens=False)


def test_documents(edge_docs, edge_rows, no_docs):
    want = []
    for i, t in edge_rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_decode(edge_docs, PATH).collect())) == sorted(want)
    assert bpe.encode_decode(no_docs, PATH).count() == 0
    back = bpe.decode_ids(bpe.encode_ids(edge_docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t in edge_rows)


COUNTS = edits.Counts(ENCODER)


def tree_of(text):
    return edits.TokenTree(ENCODER.split.findall(text), ENCODER, COUNTS)


def plain_count(text):
    return sum(len(some) for entries in ENCODER.plain([text]) for some, _ in entries)


def test_edits_against_full_recounts():
    rng = random.Random(3)
    for _ in range(120):
        text = "".join(rng.choice(PIECES) * rng.choice([1, 1, 2, 7]) for _ in range(rng.choice([0, 3, 30, 600])))
        tree = tree_of(text)
        for _ in range(10):
            at, n = rng.randint(0, len(text) + 2), rng.choice([0, 1, 2, 5, 40, 500])
            new = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 60])))
            tree.edit(at, n, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + n:]
            assert tree.text() == text and tree.n_tokens == plain_count(text) and tree.n_chars == len(text)


def test_small_edits_reencode_little():
    text = " ".join(f"word{i}" for i in range(5000))
    tree = tree_of(text)
    before = tree.encoded
    tree.edit(20000, 3, "xyz")
    assert tree.encoded - before < 20 and tree.n_tokens == plain_count(tree.text())


def test_edit_table(spark, edge_docs, edge_rows, no_docs):
    changes = spark.createDataFrame([(4, 0, 0, 3, "two words"), (4, 1, 3, 1, ""), (11, 0, 5, 0, " new "), (0, 0, 3, 4, "added"), (99, 0, 0, 0, "none")],
                                    "doc_id long, seq int, start int, length int, insert string")
    got = {r["doc_id"]: r for r in edits.count_edited(edits.with_edits(edge_docs, changes), PATH).collect()}
    assert set(got) == {i for i, _ in edge_rows}
    assert got[4]["n_tokens_edited"] == plain_count("twowords") and got[0]["n_tokens_edited"] == plain_count("added")
    assert got[8]["n_edits"] == 0 and got[8]["n_tokens"] == got[8]["n_tokens_edited"]
    assert edits.count_edited(edits.with_redactions(no_docs), PATH).count() == 0


def test_redaction_counts(edge_docs, edge_rows):
    got = {r["doc_id"]: r for r in edits.count_edited(edits.with_redactions(edge_docs), PATH).collect()}
    for i, t in edge_rows:
        text = t or ""
        for e in edits.redactions(text):
            text = text[: e["start"]] + e["insert"] + text[e["start"] + e["length"]:]
        assert got[i]["n_tokens_edited"] == plain_count(text)
    secret = "mail a.b@c.org or 10.0.0.1, +1 (338) 555-7198"
    assert [e["insert"] for e in edits.redactions(secret)] == ["<phone>", "<ip>", "<email>"]
