"""Language ID, quality, mixing and licences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwhrecon.llm import common, langid, licences, mixing, quality

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = langid.query(spark, SF).join(common.read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_edge_cases(spark, edge_docs, edge_rows, no_docs):
    model = langid.learn(common.read(spark, SF, "documents"))
    got = {r["doc_id"]: r for r in langid.identify(edge_docs, model).collect()}
    assert len(got) == len({i for i, _ in edge_rows})
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4
    assert got[10]["lang_pred"] in model["names"]
    assert langid.identify(no_docs, model).count() == 0
    assert langid.learn(no_docs)["names"] == []
    assert {r["lang_pred"] for r in langid.identify(edge_docs, langid.learn(no_docs)).collect()} == {"und"}
    kept = langid.accepted(edge_docs, model)
    assert kept.columns == edge_docs.columns and not {0, 1, 2, 3} & {r["doc_id"] for r in kept.collect()}


def test_language_spans(spark):
    docs = common.read(spark, SF, "documents").where("length(text) > 300")
    model = langid.learn(docs)
    one = {r["lang"]: r["text"][:300] for r in docs.collect() if r["lang"] in ("en", "de")}
    mixed = spark.createDataFrame([(1, one["en"] + " " + one["de"])], "doc_id long, text string")
    found = langid.spans(mixed, model).orderBy("first_word").collect()
    assert found[0]["lang"] == "en" and found[-1]["lang"] == "de" and found[0]["first_word"] == 0
    assert all(a["last_word"] + 1 == b["first_word"] for a, b in zip(found, found[1:]))


def test_viterbi_against_all_paths():
    import itertools
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(9, 3))
    starts, lengths = np.array([0, 5]), np.array([5, 4])
    got = langid.viterbi(scores, starts, lengths, 0.7)
    for s, n in zip(starts, lengths):
        worth = lambda p: sum(scores[s + i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert worth(got[s:s + n]) == pytest.approx(max(worth(p) for p in itertools.product(range(3), repeat=int(n))))


def test_quality_held_out_accuracy(spark):
    got = quality.query(spark, SF).join(common.read(spark, SF, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert common.read(spark, SF, "documents").count() == quality.query(spark, SF).count()


def test_quality_edge_cases(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(11, 1), (12, 0), (8, 1), (8, 0), (None, 1), (16, None), (40, 1), (16, 0)], "doc_id long, label int")
    scores = quality.score(edge_docs, quality.learn(edge_docs, labels)).collect()
    assert len(scores) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in scores)
    nothing = quality.learn(no_docs, labels)
    assert {r["score"] for r in quality.score(edge_docs, nothing).collect()} == {0.5}
    assert quality.score(no_docs, nothing).count() == 0


def test_quality_parts_see_the_whole_text(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = np.concatenate(list(quality.features(text)))
    monkeypatch.setattr(quality, "PART", 500)
    parts = np.concatenate(list(quality.features(text)))
    assert (np.bincount(whole, minlength=quality.BUCKETS) == np.bincount(parts, minlength=quality.BUCKETS)).mean() > 0.999


def brute_rates(tokens, p, goal, natural, steps, least):
    rate = np.full(len(tokens), max(1.0, least))
    for _ in range(steps):
        gap = (rate * tokens) @ p - goal
        rate = np.maximum(least, rate - p @ (gap / natural))
    return rate


@pytest.mark.parametrize("least,growth", [(0.0, 1.0), (1.0, 1.25), (0.9, 1.0)])
def test_rates_against_numpy(spark, least, growth):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.2, 0.2, 0.2], 300)
    tokens = rng.integers(0, 500, 300)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "_tokens long, _p array<double>")
    names, targets = ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}
    residuals, reached, goal = mixing.fit(rows, names, targets, least, growth)
    natural = tokens @ p
    rate = brute_rates(tokens, p, np.array(goal), natural, len(residuals), least)
    got = np.array([r[0] for r in rows.select(mixing.rate_of(residuals, least)).collect()])
    assert np.allclose(got, rate) and np.allclose((rate * tokens) @ p, reached) and (rate >= least).all()
    if least == 0:
        assert np.allclose(reached, goal, rtol=1e-4)


def test_mixing_documents(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(45)] + [(8, "y"), (8, "x"), (None, "x"), (9, None)], "doc_id long, domain string")
    out, model, residuals = mixing.mix(edge_docs, labels, {"x": 0.5, "y": 0.5, "unknown": 3.0})
    rows = out.collect()
    assert len(rows) == len(edge_rows) and all(r["rate"] >= 0 for r in rows)
    copies = mixing.mixed(edge_docs, model, residuals, 0.0)
    assert copies.columns == edge_docs.columns
    same = mixing.mix(edge_docs, labels.where("false"), {"x": 1.0})
    assert {r["rate"] for r in same[0].collect()} == {1.0} and mixing.mixed(edge_docs, same[1], [], 0.0).count() == len(edge_rows)
    assert mixing.mix(no_docs, labels, {"x": 1.0})[0].count() == 0


def test_domain_posteriors_on_labels(spark):
    docs, labels = common.read(spark, SF, "documents"), mixing.domains(common.read(spark, SF, "labels"))
    got = mixing.mix(docs, labels, mixing.TARGETS)[0].join(labels.withColumnRenamed("domain", "label"), "doc_id").toPandas()
    assert (got.domain == got.label).mean() > 0.9


def test_plans_are_native(spark):
    docs, labels = common.read(spark, SF, "documents"), mixing.domains(common.read(spark, SF, "labels"))
    _, model, residuals = mixing.mix(docs, labels, mixing.TARGETS)
    for df in (mixing.mixed(docs, model, residuals, 0.0), licences.query(spark, SF)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_licence_inheritance(spark):
    mit, gpl = licences.TEMPLATES[5][1], licences.TEMPLATES[4][1]
    rows = [("r/LICENSE", "Some words.\n" + mit, True), ("r/a/x.py", None, False), ("r/a/b/LICENSE", gpl, True), ("r/a/b/LICENSE2", "x " + gpl, True),
            ("r/a/b/c/y.py", "", None), ("r/a/b/z.py", "code\n" + mit, False), ("q/y.py", "a licence of no known kind", False), (None, "x", True),
            ("top", "no", False), ("r/a/x.py", None, False), ("long", "word " * 30000 + "\n" + mit, False)]
    files = spark.createDataFrame([(*r, 1, "x") for r in rows], "path string, text string, licence_file boolean, dir int, cosine string")
    got = {r["path"]: (r["licence"], r["how"], r["from_dir"]) for r in licences.scan(files).collect()}
    assert got["r/a/x.py"] == ("MIT", "directory", "r/") and got["r/a/b/c/y.py"] == ("GPL-3.0", "directory", "r/a/b/")
    assert got["r/a/b/z.py"] == ("MIT", "header", None) and got["q/y.py"] == (None, "none", None) and got["top"][1] == "none"
    assert got["long"][0] == "MIT" and got[None][1] == "none" and licences.scan(files).count() == len(rows)
    assert licences.scan(files.where("false")).count() == 0
