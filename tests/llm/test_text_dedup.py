"""Near-dedup and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from kwhrecon.llm import fmindex, minhash, substrings, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = lowered(t)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    comp = {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            x, y = rows[a][0], rows[b][0]
            low = min(comp[x], comp[y])
            if comp[x] != low or comp[y] != low:
                comp[x] = comp[y] = low
                changed = True
    return sorted((i, len(s), comp[i], comp[i] == i) for (i, _), s in zip(rows, sets))


def brute_repeats(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_components_match_brute_force(edge_docs, edge_rows):
    got = minhash.near_dedup(edge_docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_components(edge_rows)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_match_brute_force(edge_docs, edge_rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = substrings.digests(edge_docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_repeats(edge_rows)


def test_rewritten_documents_keep_columns(edge_docs, edge_rows):
    out = substrings.without_repeats(edge_docs)
    assert out.columns == edge_docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    want = {i: n - k for i, n, k, _ in brute_repeats(edge_rows)}
    for i, t in edge_rows:
        if want[i] == len(WORD.findall(t or "")):
            assert texts[i] == t
        elif want[i]:
            assert len(texts[i].split(" ")) == want[i]
        else:
            assert i not in texts


def test_empty_tables(no_docs):
    assert minhash.near_dedup(no_docs).count() == 0
    assert substrings.digests(no_docs).count() == 0
    assert substrings.without_repeats(no_docs).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 2000):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = np.unique(np.concatenate([a[: max(1, size * 4 // 5)], rng.integers(0, 2**63, size // 5, dtype=np.uint64)]))
        x, y = minhash.sketch(np.unique(a)), minhash.sketch(b)
        assert (x != np.iinfo(np.uint64).max).all()
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - want) < 0.2


def test_word_hashes_tell_words_apart():
    raw = "a ab abcdefgh abcdefghi abcdefgh i \t ab".encode()
    h = words.word_hashes(raw)
    assert len(h) == 7 and h[1] == h[6] and h[2] == h[4] and len(set(h.tolist())) == 5
    assert (words.word_hashes(b"ABc ab", lower=True) == words.word_hashes(b"abc ab")).all()


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 500)
    text[::50] = 0
    index = fmindex.FMIndex(text, 4, np.arange(500))
    for _ in range(50):
        at, n = rng.integers(0, 490), rng.integers(1, 8)
        pattern = text[at:at + n]
        lo, hi = np.zeros(1, np.int64), np.full(1, 500)
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        found = [i for i in range(500) if (np.r_[text, text][i:i + n] == pattern).all()]
        assert hi[0] - lo[0] == len(found) and index.owner_min(lo, hi)[0] == min(found)
