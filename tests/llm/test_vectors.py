"""Vector operators against brute force."""

import numpy as np
import pytest

from kwhrecon.llm import lattice, topk
from kwhrecon.llm.vectors import finite

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, cell long, dim int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for c in range(12):
        base = rng.standard_normal(64)
        out += [base + rng.standard_normal(64) * s * np.linalg.norm(base) / 8 for s in rng.uniform(0, 0.4, 8)]
    out += [out[0]] * 3 + [out[0] * 2] + [np.zeros(64), np.full(64, 1e30), np.full(64, -1e30)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [1.0, None]), (n + 3, [float("nan")] * 64), (n + 4, [float("inf")] + [0.0] * 63),
             (n + 5, [1.0, 2.0, 3.0]), (n + 6, [2.0, 4.0, 6.0])]
    return rows


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)


def test_links_and_components(table, rows):
    got = {r["vec_id"]: r for r in lattice.near_dedup(table).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if usable(v) and any(v)}
    want, comp = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    links = []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a] / np.abs(good[a]).max(), good[b] / np.abs(good[b]).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    links.append((a, b))
                    want[a] += 1
                    want[b] += 1
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(want.values())
    assert all(got[i]["n_links"] <= want[i] for i in want)
    assert all(got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i) for i in want)


def test_blocks_lose_no_link(table):
    whole = sorted(map(tuple, lattice.near_dedup(table).collect()))
    assert sorted(map(tuple, lattice.near_dedup(table, block=3).collect())) == whole


def test_nearest_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)) * 2
    p = lattice.nearest_e8(x)
    assert ((p.sum(1) % 2) == 0).all() and len(lattice.minimal_vectors()) == 240
    assert ((2 * p % 2).min(1) == (2 * p % 2).max(1)).all()
    distance = ((x - p) ** 2).sum(1)
    for step in lattice.minimal_vectors():
        assert (distance <= ((x - p - step) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("tile,shard", [(1024, 8192), (2, 7)])
def test_top_k(spark, rows, table, tile, shard):
    # components of 1e30 are beyond what a long holds after scaling: the nearest long
    base = table.where(finite("embedding")).select("vec_id", topk.scaled_ints("embedding").alias("ints"))
    got = topk.exact_top_k(base.where("vec_id % 10 = 0"), base, 10, tile, shard, 2).collect()
    low, high = -(2**63), 2**63 - 1
    ints = {i: [max(low, min(high, int(np.floor(1024 * float(np.float32(x)))))) for x in v] for i, v in rows if usable(v)}
    want = []
    for q in ints:
        if q % 10 == 0:
            scored = sorted((-max(low, min(high, sum(x * y for x, y in zip(ints[q], v)))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lattice.near_dedup(none).count() == 0
    base = none.select("vec_id", topk.scaled_ints("embedding").alias("ints"))
    assert topk.exact_top_k(base, base).count() == 0
