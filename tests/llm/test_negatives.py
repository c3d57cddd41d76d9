"""Hard negatives against brute force in Python integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwhrecon.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row long, ints string, shard long, asks int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for c in range(6):
        base = rng.standard_normal(16)
        out += [(base + rng.standard_normal(16) * 0.7, (c + int(rng.random() < 0.4)) % 6) for _ in range(25)]
    rows = [(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(out)]
    n = len(rows)
    rows += [(n + i, rows[10][1], k) for i, k in enumerate([0, 0, 1, 1])]  # equal vectors: ties
    n = len(rows)
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (n + 2, [1.0, None], 2), (n + 3, [float("nan")] * 16, 2),
             (n + 4, [float("inf")] + [0.0] * 15, 2), (n + 5, [1e307] * 16, 2), (n + 6, [], 0), (n + 7, [0.0] * 16, 0),
             (None, rows[3][1], 2), (200, [2.0, 1.0], 3), (201, [1.0, 2.0], 3), (202, [1.0, 0.5], 4), (203, [1.5, 0.25], 4)]
    rows += [(300, [3e80] * 4, 7), (301, [2e80] * 4, 7), (302, [1e80] * 4, 8), (310, [2.0**40] * 8, 7), (311, [2.0**39] * 8, 7), (312, [2.0**38] * 8, 8)]
    return rows + [rows[20], rows[20], (20, rows[21][1], 5)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def brute(rows, every, positives=5, negatives_=10):
    use = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x * 256) for x in v):
            continue
        use.append((i, label, [int(np.floor(x * 256)) for x in v]))
    anchors = {(i, lab, tuple(v)) for i, lab, v in use if i % every == 0}
    out = []
    for a, lab, v in anchors:
        others = [(max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, k) for i, k, w in use if i != a and len(w) == len(v)]
        others.sort(key=lambda o: (-o[0], o[1]))
        for p, pid, _ in [o for o in others if o[2] == lab][:positives]:
            inside = [o for o in others if o[2] != lab and 30 * p <= 100 * o[0] <= 90 * p][:negatives_]
            out += [(a, pid, r, nid, p, s) for r, (s, nid, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile,shard", [(1024, 8192), (3, 11)])
def test_against_brute_force(spark, rows, tile, shard):
    got = negatives.hard_negatives(negatives.usable(table(spark, rows), "embedding", "label"), F.col("vec_id") % 10 == 0, 5, 10, tile, shard, 2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_one_label_and_hot_rows(spark, rows):
    """A label of nine tenths of all rows is cut into shards; equal rows spread over them."""
    some = [(i, v, 0 if i % 10 else 1) for i, v, _ in rows[:100]] + [(500 + i, rows[7][1], 0) for i in range(60)] + [(900, rows[7][1], 0)] * 40
    got = negatives.hard_negatives(negatives.usable(table(spark, some), "embedding", "label"), F.col("vec_id") % 50 == 0, 5, 10, 2, 16, 2)
    assert sorted(map(tuple, got.collect())) == brute(some, 50)


def test_residues_give_exact_scores():
    rng = np.random.default_rng(2)
    for limit, n in ((1, 3), (255, 64), (10**6, 700), (2**40, 33), (2**52, 5)):
        a, b = (rng.integers(-limit, limit + 1, (7, n)).astype(float) for _ in range(2))
        exact = [[max(-2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert negatives.exact_scores(a, b).tolist() == exact
    for p in (3, 251, 257, 2039):
        assert abs(negatives.balanced(np.array([1e300, -1e300, 5.0, -5.0]), p)).max() <= (p - 1) // 2
    assert [negatives.window(p) for p in (0, 1, 10, -10, 7)] == [(0, 0), (1, 0), (3, 9), (-3, -9), (3, 6)]


def test_empty_tables(spark):
    none = negatives.usable(table(spark, []), "embedding", "label")
    assert negatives.hard_negatives(none, F.col("vec_id") % 2 == 0).count() == 0
    alone = negatives.usable(table(spark, [(0, [1.0, 2.0], 1)]), "embedding", "label")
    assert negatives.hard_negatives(alone, F.col("vec_id") % 2 == 0).count() == 0


def test_query_on_a_table_with_other_columns(spark, rows, tmp_path):
    table(spark, [r for r in rows if r[0] is None or r[0] < 299]).write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, v, None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows if i is None or i < 299]
    assert sorted(map(tuple, negatives.query(spark, str(tmp_path)).collect())) == brute(moved, 100)
