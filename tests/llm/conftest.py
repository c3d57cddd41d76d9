import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, key long, _crc long, _kept string, component_id string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    passage = words(rng, 70)
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "123 -- !!"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d"),
        (8, " ".join(words(rng, 30000, 5000))), (9, "x" * 30000), (10, "日本語 のテキスト ñandú x\u001cy"),
        (11, " ".join(passage)), (12, " ".join(words(rng, 40) + passage + words(rng, 40))),
        (13, "\n".join(words(rng, 5) + passage)), (14, " ".join(passage[:49])), (15, " ".join(passage[1:51])),
        (16, " ".join((["same"] * 200))), (17, " ".join((["same"] * 120))),
        (18, "it's we'll <|endoftext|> done"),
    ]
    base = words(rng, 200)
    for i in range(20, 32):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = "edit"
        rows.append((i, " ".join(near)))
    rows += [(40 + i, " ".join(words(rng, 80))) for i in range(6)]
    rows += [rows[20], rows[11]]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    full = [(i, t, ["en", None, "xx"][i % 3], "src0" if i % 3 else None, 1, 5, 6, 7, "k", "c") for i, t in edge_rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
