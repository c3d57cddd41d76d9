"""Language ID where one language holds nearly all rows, or none is known."""

import random

from kwhrecon.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def test_a_rare_language_teaches(spark):
    rng = random.Random(8)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(12))
    rows = [(i, say("abcdefgh"), "aa") for i in range(600)] + [(1000 + i, say("rstuvwxyz"), "zz") for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(docs, sample=5)
    assert model["names"] == ["aa", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    ids = langid.teachers(docs, 5).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in ids} == {"aa": 5, "zz": 3}


def test_texts_with_letters_stay_without_a_model(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 -- !!", None), (3, None, None), (4, "", None), (5, "слово", None)], SCHEMA)
    kept = langid.accepted(docs, langid.learn(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 5}
