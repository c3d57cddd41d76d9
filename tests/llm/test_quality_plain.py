"""The quality classifier against plain loops over words, n-grams and gradient steps."""

import math

import numpy as np

from kwhrecon.llm import quality

P, ALL = 0x100000001B3, 2**64 - 1


def bucket(h, salt):
    h = (h + salt) * 0x9E3779B97F4A7C15 & ALL
    h ^= h >> 32
    return (h * 0xD6E8FEB86659FD93 & ALL) >> 47


def plain_features(text):
    white = {9, 10, 11, 12, 13, 32}
    code = [32 if b in white else b for b in b" " + text.encode("utf-8", "surrogatepass") + b" "]
    words = bytes(code).split(b" ")
    hashes = [sum(b * pow(P, i + 1, 2**64) for i, b in enumerate(w)) & ALL for w in words if w]
    found = [bucket(h, 1) for h in hashes]
    found += [bucket(0, 99) for a, b in zip(hashes, hashes[1:]) if a == b]
    for n in (2, 3):
        for i in range(len(code) - n + 1):
            gram = code[i:i + n]
            if 32 not in gram[1:-1]:
                h = 0
                for b in gram:
                    h = (h * P + b) & ALL
                found.append(bucket(h, n))
    return sorted(found) if text else []


TEXTS = ["", " ", "a", "the the cat", "Ünï ção\tçà", "x\x0by  z", "one two two three", "aaa bbb aaa bbb", "9 9 9", "good clear text here"]


def bag(text):
    at, n = np.unique(np.array(plain_features(text), np.int64), return_counts=True)
    return at, n


def test_features_are_those_of_a_plain_loop():
    for text in TEXTS:
        parts = list(quality.features(text))
        assert sorted(np.concatenate(parts).tolist() if parts else []) == plain_features(text), text


def test_fit_and_scores_match_plain_loops(spark):
    steps, rate = 40, 0.1
    bags = [(i % 2, *bag(t)) for i, t in enumerate(TEXTS)]
    margin, bias = quality.fit(bags, steps, rate)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32)
    used = sorted({int(b) for _, at, _ in bags for b in at})
    rows = {b: [float(v) for v in vectors[b]] for b in used}
    out, offset = [[0.0] * quality.DIM for _ in range(2)], [0.0, 0.0]
    taught = [(y, dict(zip(at.tolist(), n.tolist()))) for y, at, n in bags if len(at)]
    total, done = -(-steps // len(taught)) * len(taught), 0
    while done < total:
        for i in rng.permutation(len(taught)):
            y, counts = taught[i]
            size = sum(counts.values())
            step = rate * (1 - done / total)
            done += 1
            hidden = [sum(n / size * rows[b][d] for b, n in counts.items()) for d in range(quality.DIM)]
            z = [sum(o * h for o, h in zip(out[k], hidden)) + offset[k] for k in (0, 1)]
            grown = [math.exp(v - max(z)) for v in z]
            gap = [g / sum(grown) - (k == y) for k, g in enumerate(grown)]
            back = [sum(gap[k] * out[k][d] for k in (0, 1)) for d in range(quality.DIM)]
            for k in (0, 1):
                out[k] = [o - step * gap[k] * h for o, h in zip(out[k], hidden)]
                offset[k] -= step * gap[k]
            for b, n in counts.items():
                rows[b] = [v - step * math.sqrt(len(counts)) * n / size * g for v, g in zip(rows[b], back)]
    plain = {b: sum(v * (q - p) for v, p, q in zip(rows[b], *out)) for b in used}
    assert np.allclose([margin[b] for b in used], [plain[b] for b in used], atol=1e-5) and math.isclose(bias, offset[1] - offset[0], abs_tol=1e-5)

    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "the cat"), (98, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, (margin, bias)).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, text in [*enumerate(TEXTS), (None, "the cat"), (98, "")]:
        found = plain_features(text)
        mean = sum(float(margin[b]) for b in found) / len(found) if found else 0.0
        assert math.isclose(got[i], 1 / (1 + math.exp(-(bias + mean))), abs_tol=2e-6), text


def test_a_tie_counts_as_label_one(spark):
    docs = spark.createDataFrame([(1, "any text"), (2, "")], "doc_id long, text string")
    model = quality.fit([(1, *bag("one class teaches nothing"))])
    assert [r["score"] for r in quality.score(docs, model).collect()] == [0.5, 0.5]
