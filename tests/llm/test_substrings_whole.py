"""Substring dedup of rows that repeat an id with different texts, and of rows without one."""

import random

import pytest

from kwhrecon.llm import substrings
from test_text_dedup import brute_repeats

SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture
def rows():
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    a, b, c = some(70), some(70), some(90)
    texts = [(1, some(30) + a + some(20)), (2, some(10) + a + some(60)), (2, some(45) + b + some(15)), (2, c + some(5)), (3, some(5) + b + c),
             (4, some(80)), (4, a[:65] + some(60)), (5, some(33) + c[:60] + some(9) + b[5:68]), (1, some(200))]
    return [(i, " ".join(t)) for i, t in texts]


@pytest.mark.parametrize("hot", [4096, 1])
def test_each_text_of_an_id_is_cut_by_its_own_windows(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, substrings.digests(docs).collect())) == brute_repeats(rows)
    kept = [(r["doc_id"], len(r["text"].split())) for r in substrings.without_repeats(docs).collect()]
    assert sorted(kept) == sorted((i, n - gone) for i, n, gone, _ in brute_repeats(rows) if n > gone)


def test_rows_without_an_id_hide_no_repeats(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in [*rows, (None, rows[0][1]), (None, rows[4][1])]], SCHEMA)
    got = [tuple(r) for r in substrings.digests(docs).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute_repeats(rows)
    assert [r[2] for r in got if r[0] is None] == [0, 0]
