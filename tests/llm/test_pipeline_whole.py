"""The pipeline's stages on tables unlike the test data."""

import random

import pytest

import corpus_pipeline
from kwhrecon.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["clean", "low", "toxic"]


@pytest.mark.parametrize("natural", [(0.6, 0.3, 0.1), (0.33, 0.33, 0.34), (0.4, 0.1, 0.5)])
def test_every_target_is_reached_from_any_mix(spark, natural):
    rows = spark.createDataFrame([(round(1000 * n), [float(i == k) for i in range(3)]) for k, n in enumerate(natural)], "_tokens long, _p array<double>")
    _, reached, goal = mixing.reach(rows, NAMES, corpus_pipeline.TARGETS, corpus_pipeline.LEAST, corpus_pipeline.GROWTH)
    assert [x / sum(reached) for x in reached] == pytest.approx([0.8, 0.1, 0.1], abs=1e-3) and sum(goal) >= 1.25 * 1000


def test_targets_of_mixed_documents_are_reached(spark):
    rows = [(300, [0.96, 0.02, 0.02]), (300, [0.02, 0.96, 0.02]), (400, [0.02, 0.02, 0.96])]
    df = spark.createDataFrame(rows, "_tokens long, _p array<double>")
    _, reached, goal = mixing.reach(df, NAMES, corpus_pipeline.TARGETS, 1.0, 1.25)
    assert mixing.gap(reached, goal) <= mixing.MET


def kinds_table(spark, folder, counts):
    """Documents of three plain kinds, and the labels of all of them."""
    rng = random.Random(4)
    words = {"clean": lambda: f"word{rng.randrange(300)}", "low": lambda: rng.choice(["##$$", "!!", "%%", "777"]),
             "toxic": lambda: rng.choice(["vile", "hateful", "SLUR", f"word{rng.randrange(300)}"])}
    rows, labels, kind = [], [], {}
    for name, n in counts.items():
        for _ in range(n):
            i = len(rows)
            text = " ".join(words[name]() for _ in range(60))
            rows.append((i, text, "en", "s", len(text)))
            labels.append((i, int(name != "low"), int(name == "toxic")))
            kind[i] = name
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, SCHEMA), kind


@pytest.mark.parametrize("counts", [(120, 30, 150), (100, 100, 100)])
def test_mix_stage_far_from_the_targets(spark, tmp_path, counts):
    docs, kind = kinds_table(spark, tmp_path, dict(zip(NAMES, counts)))
    got = [kind[r["doc_id"]] for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()]
    assert [got.count(n) / len(got) for n in NAMES] == pytest.approx([0.8, 0.1, 0.1], abs=0.02)
    assert all(got.count(n) >= c for n, c in zip(NAMES, counts))


def test_missed_targets_are_named(spark, tmp_path):
    docs, _ = kinds_table(spark, tmp_path, {"clean": 40, "low": 40})
    labels = mixing.domains(spark.read.parquet(f"{tmp_path}/labels.parquet"))
    with pytest.warns(UserWarning, match="misses its targets.*low"):
        _, model, _ = mixing.mix(docs, labels, {"clean": 1.0, "low": 0.0}, 1.0, 1.25)
    assert set(model["reached"]) == set(model["goal"]) == {"clean", "low"}


def test_near_dedup_keeps_texts_of_null_and_repeated_ids(spark):
    rng = random.Random(6)
    text = [" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(7)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, text[1] + " more"), (None, text[2]), (None, text[3]), (None, text[3]),
            (None, text[4]), (3, text[4]), (4, text[5]), (4, text[5]), (5, text[6]), (6, text[6]), (7, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == len(set(got))
    texts = {t for _, t in got}
    assert {text[0], text[2], text[3], text[4], text[5], text[6]} <= texts and (text[1] in texts) != (text[1] + " more" in texts)
    assert {(None, text[2]), (None, text[3]), (3, text[4]), (4, text[5]), (5, text[6]), (7, None), (None, None)} <= set(got)
    assert len(got) == 9


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    """Columns that are named as the stages' own pass through; tables without rows give none."""
    import corpus_pipeline
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key int, _text string, _row string, _least int, key long, row int, id string"
    rows = [(i, f"the {i} little words of text number {i * 7} are written here for a test", "en", "s", 1, 2, "t", "r", 3, 4, 5, "d") for i in range(12)]
    for some in (rows + [(None, None, None, None, None, 2, "t", "r", 3, 4, 5, "d")], []):
        docs = spark.createDataFrame(some, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns, name
                kept = out.collect()
                assert bool(kept) == bool(some) and all((r["_key"], r["_text"], r["_row"], r["_least"], r["key"], r["row"], r["id"]) == (2, "t", "r", 3, 4, 5, "d") for r in kept), name
            else:
                assert (out.count() > 0) == bool(some)
