"""Every link of op7 counts in one task only: its first meeting."""

import numpy as np
import pytest

from kwhrecon.llm import lattice


def test_cells_do_not_depend_on_company():
    rng = np.random.default_rng(5)
    for dim in (8, 64, 100, 384):
        v = rng.standard_normal((300, dim))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        home, near = lattice.cells(v, 12, 8, 0.5)
        for some in (np.arange(1), np.arange(7, 9), rng.permutation(300)[:65], rng.permutation(300)[:130]):
            mine, other = lattice.cells(v[some], 12, 8, 0.5)
            assert (mine == home[some]).all() and (np.sort(other) == np.sort(near[some])).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_a_large_group_of_near_vectors(spark, block):
    """Hundreds of vectors that all link, and copies of them: counts are whole, what leaves the tasks is no square."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal(32)
    near = [base + rng.standard_normal(32) * 0.12 for _ in range(150)]
    rows = [(i, v.tolist()) for i, v in enumerate(near + [near[3]] * 20 + [rng.standard_normal(32) for _ in range(30)])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (m @ m.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in lattice.near_dedup(table, block=block).collect()}
    assert [got[i]["n_links"] for i in range(200)] == want.tolist()
    assert all(got[i]["component_id"] == 0 for i in range(170))
    from pyspark.sql import functions as F
    classes = table.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    facts = lattice.near_facts(classes, block=block)
    edges = facts.where("least is not null").count()
    assert edges < 150 * 60 and edges < (want[:150].sum() // 2) * (1 if block < 100 else 0.2)
