"""Near-dedup: members of a bucket meet as sketches, texts only for pairs that nearly agree."""

import numpy as np
import pytest

from kwhrecon.llm import minhash
from tests.llm.test_text_dedup import brute_components


def chain(rng, n, step):
    """Texts that each change ``step`` words of the one before: neighbours link, distant ones share buckets only."""
    words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    out = []
    for _ in range(n):
        for at in rng.integers(0, len(words), step):
            words[at] = f"w{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_small_blocks_find_every_link(spark, monkeypatch, block):
    rng = np.random.default_rng(11)
    texts = chain(rng, 25, 3) + chain(rng, 25, 7) + ["same words here for all"] * 5 + [None, ""]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_only_near_pairs_go_on():
    import pyarrow as pa
    rng = np.random.default_rng(12)
    prints = [rng.integers(0, 256, minhash.COORDINATES, dtype=np.uint8) for _ in range(3)]
    prints.append(prints[0].copy())  # row 3 agrees with row 0 in all bins
    bands = np.arange(minhash.BANDS, dtype=np.int64)
    side = [0] * 4 + [1] * 4
    table = pa.RecordBatch.from_pydict({
        "key": pa.array([0] * 8, pa.int64()), "i": pa.array([0] * 8, pa.int32()), "j": pa.array([0] * 8, pa.int32()), "side": pa.array(side, pa.int32()),
        "rep": pa.array([0, 1, 2, 3] * 2, pa.int64()), "comp": pa.array([0, 1, 2, 3] * 2, pa.int64()),
        "print": pa.array([p.tobytes() for p in prints] * 2), "bands": pa.array([bands.tolist()] * 8, pa.list_(pa.int64()))})
    kept = [(r["side"], r["rep"]) for b in minhash._near_rows([table], False) for r in b.to_pylist()]
    assert kept == [(0, 0), (1, 3)]
