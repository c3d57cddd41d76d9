"""Recall of the links of op7 just above its threshold."""

import numpy as np

from kwhrecon.llm import lattice


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(11)
    n, dim = 1000, 64
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, other = unit(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    other = unit(other - (other * a).sum(1, keepdims=True) * a)
    cosine = np.linspace(0.9005, 0.92, n)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, cosine * a + np.sqrt(1 - cosine ** 2) * other]))]
    found = {r["vec_id"] for r in lattice.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").collect()}
    hit = np.array([i in found for i in range(n)])
    low, high = hit[: n // 2].mean(), hit[n // 2:].mean()
    print(f"recall: cosine 0.90-0.91 {low:.4f}, 0.91-0.92 {high:.4f}")
    assert low >= 0.99 and high >= 0.99
