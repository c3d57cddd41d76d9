"""Stored token trees: batches of edits from tables, special tokens, what is encoded again."""

import random

import public_tokenizers
import pytest

from kwhrecon.llm import bpe, common, edits

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = bpe.Encoder(bpe.load(PATH))
PIECES = ["a", "b", "'", "s", "re", " ", "  ", "\n", "1", "é", "日", "<|endoftext|>", "<|endof", "text|>", "the", "ing", "!", "'ll"]


def count(text, special):
    runs = ENCODER.encode([text]) if special else ENCODER.plain([text])
    return sum(len(some) for entries in runs for some, _ in entries)


@pytest.mark.parametrize("special", [False, True])
def test_kept_trees_follow_edits(special):
    counts = edits.Counts(ENCODER, special)
    rng = random.Random(12)
    for _ in range(80):
        text = "".join(rng.choice(PIECES) * rng.choice([1, 1, 2, 7]) for _ in range(rng.choice([0, 3, 30, 600])))
        chars, tokens = (x.tolist() for x in counts.leaf_sums(counts.split(text)))
        assert sum(tokens) == count(text, special)
        for _ in range(4):  # each batch starts from the stored sums
            tree = edits.TokenTree.kept(text, chars, tokens, counts)
            for _ in range(3):
                at, n = rng.randint(0, len(text) + 2), rng.choice([0, 1, 2, 5, 40, 500])
                new = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 60])))
                tree.edit(at, n, new)
                at = min(at, len(text))
                text = text[:at] + new + text[at + n:]
            assert tree.text() == text and tree.n_tokens == count(text, special) and tree.n_chars == len(text)
            chars, tokens = tree.sums()


def test_a_second_batch_touches_only_its_leaves(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    docs = spark.createDataFrame([(1, text, "x"), (2, "short", "y"), (2, "short", "y"), (None, None, "z")], "doc_id long, text string, tokens string")
    trees = common.stored(edits.token_trees(docs, PATH, keep_texts=True))
    for batch, (at, new) in enumerate([(9000, "abc "), (20000, "<|endoftext|> x")]):
        table = spark.createDataFrame([(1, 0, at, 2, new), (7, 0, 0, 0, "none")], "doc_id long, seq int, start int, length int, insert string")
        after = common.stored(edits.apply_edits(edits.with_edits(trees, table), PATH))
        text = text[:at] + new + text[at + 2:]
        got = {r["doc_id"]: r for r in after.collect()}
        assert after.count() == 4 and got[1]["text"] == text and got[1]["n_tokens"] == count(text, False) == sum(got[1]["tokens"])
        assert got[1]["n_edits"] == 1 and got[1]["n_reencoded"] < 100 and got[2]["n_reencoded"] == 0
        assert got[None]["n_tokens"] == 0 and got[None]["chars"] == [0]
        trees = after.select(*trees.columns)


def test_counts_agree_with_encoding(spark, edge_docs, edge_rows, no_docs):
    trees = common.stored(edits.token_trees(edge_docs, PATH, special=True, find=edits.redactions))
    encoded = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_decode(edge_docs, PATH).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in edits.counts_after(trees, PATH, special=True).collect()} == encoded
    assert edits.counts_after(edits.token_trees(no_docs, PATH, find=edits.redactions), PATH).count() == 0
