"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kwhrecon.llm import phrases

SCHEMA = "doc_id long, text string, lang string, w1 string, n long, a long, group long, depth int, part int"


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=10, top=2000, cover=50):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, c in counts.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= cover * a for q, b in held.items() if len(q) > len(p)):
                continue
            s, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = lambda: rng.choice(["The", "the", "of", "Ab", "ab", "x", "ñu", "Ñu", "日本", "q\x00z", "it's"] + [f"w{i}" for i in range(12)])
    out = [(None, "en"), ("", "en"), (" \t ", None), (".,;", "de"), ("one", None), ("the of", "")]
    for i in range(120):
        text = "".join(word() + rng.choice([" "] * 12 + ["\t ", "  ", ". ", ",", "\n", "\x0b", "\x0c", " ; ", "!?"]) for _ in range(rng.randrange(60)))
        out.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    out += [("a very common line of words", "en")] * 40 + [("new york city", "de")] * 15 + [("new york", "de")] * 20
    out.append((" ".join(word() for _ in range(20000)), "en"))
    out.append(("z" * 5000 + " " + " ".join(["p", "q", "r"] * 300), "fr"))
    return out + out[10:20]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1, 2, 3, 4, 5) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("budget,size", [(1 << 18, 6 << 20), (400, 1000), (40, 64)])
def test_against_plain_counts(spark, rows, budget, size):
    """Small budgets extend prefixes to pairs and triples; small slices cut texts between and within pieces."""
    got = phrases.collocations(table(spark, rows), budget=budget, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_limits(spark, rows):
    got = phrases.collocations(table(spark, rows), least=4, top=7, cover=20, budget=1000, parts=(3,))
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 7, 20)


def test_prefixes_are_extended_until_they_fit(spark, rows):
    words, nodes = phrases.phrase_counts(table(spark, rows), budget=400, size=1000)
    want = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            want.update((lang if lang is not None else "und", *ws[i:i + k]) for k in (2, 3) for i in range(len(ws) - k + 1))
    names = {r["w1"]: (r["lang"], r["word"]) for r in words.collect()}
    got = {(names[r["w1"]][0], *(names[r[w]][1] for w in ("w1", "w2", "w3") if r[w])): r["a"] for r in nodes.collect()}
    assert got == {k: a for k, a in want.items() if a >= 10}
    assert words.where("a > 100").count() > 5


def test_cuts_lose_nothing():
    raw = b"aa bb cc dd. " + b"x" * 50 + b" ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt,uu vv ww"
    for size in range(5, 60):
        got = Counter()
        at = 0
        for part, counted in phrases.parts_of(raw, size):
            assert part[:counted] == raw[at:at + counted]
            at += counted
            words, _, places, count = phrases.suffixes(part, counted, 1, phrases.seed_of("en", 0))
            got.update({words[int(i)].as_py(): int(c) for i, c in zip(places[0], count)})
        assert at == len(raw)
        assert got == Counter(re.findall("[^\x20\x09.,;:!?\x0a-\x0d]+", raw.decode()))


def test_words_that_share_an_id_get_others(spark, rows, monkeypatch):
    """Ids of four bits for the first seed: words share them; the next seed tells them apart."""
    top, low, whole = np.uint64(1 << 63), np.uint64(15), phrases.word_hashes
    monkeypatch.setattr(phrases, "word_hashes", lambda raw: whole(raw) & ~top)
    monkeypatch.setattr(phrases, "seed_of", lambda lang, seed: np.uint64(0) if seed == 0 else top ^ np.uint64(hash(lang) % 1000 << 8))
    monkeypatch.setattr(phrases, "mix", lambda h: np.where(h & top, h, h & low))
    words, seed = phrases.vocabulary(table(spark, rows))
    assert seed > 0
    assert words.count() == words.select("w1").distinct().count() == words.select("lang", "word").distinct().count()


def test_empty_tables(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(None, None), ("", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**15 - 1, 10**15 - 1, 10**15 - 1), (999_999_999_999_999, 10**15 - 1, 3 * 10**14)], "a long, l long, r long")
    big = big.unionByName(spark.createDataFrame([(3 * 10**14, 9 * 10**14, 7 * 10**14)], "a long, l long, r long"))
    got = [(r[0], r[1], r[2], r[3]) for r in big.select("a", "l", "r", phrases.score("a", "l", "r")).collect()]
    assert all(s == 1000000 * a * a // (left * right) for a, left, right, s in got)
