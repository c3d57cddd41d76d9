"""Many languages, workers without the package, clashing columns, repeated and null ids, shared folders."""

import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest

from kwhrecon.llm import common, langid, minhash

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_hundreds_of_languages():
    scores = np.full((20, 300), -5.0)
    scores[:, 280] = -1.0
    assert (langid.viterbi(scores, np.array([0, 12]), np.array([12, 8]), 3.0) == 280).all()


def test_lanes_are_bounded(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(langid, "LETTERS", 10)
    monkeypatch.setattr(langid, "LANES", 3)
    texts = ["abcd", None, "x" * 30, "ab", "cd", "ef", "gh"]
    parts = list(langid.lanes(pa.array(texts)))
    assert [t for p in parts for t in p] == [t or "" for t in texts]
    assert all(len(p) <= 3 and (len(p) == 1 or sum(map(len, p)) <= 10) for p in parts)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A driver in another folder; the package's folder is taken out of the workers' path."""
    code = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from kwhrecon.llm import edits, langid, negatives, phrases, bpe
        from pyspark.sql import functions as F
        docs = spark.createDataFrame([(i, ["some english words here", "quelques mots en langue"][i % 2] * 3, ["en", "fr"][i % 2]) for i in range(20)], "doc_id long, text string, lang string")
        def own(batches):
            import importlib.util
            assert importlib.util.find_spec("kwhrecon") is None
            yield from batches
        docs.mapInArrow(own, docs.schema).count()
        model = langid.learn(docs)
        assert langid.identify(docs, model).count() == 20 and langid.accepted(docs, model).count() == 20 and langid.spans(docs, model).count() == 20
        assert phrases.collocations(docs, least=2).count() > 0
        assert edits.count_edited(edits.with_redactions(docs), bpe.default_path()).count() == 20
        rows = spark.createDataFrame([(i, [float(i % 5), 1.0 + i], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int")
        assert negatives.hard_negatives(negatives.usable(rows, "embedding", "label"), F.col("vec_id") % 10 == 0).count() >= 0
        print("fine")
    """)
    script = tmp_path / "driver.py"
    script.write_text(code)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-3000:]


def test_rows_with_clashing_names_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g", 5, "x", 1, 2, "k"), (1, "quite another text of some words", 6, "x", 1, 2, "k"), (1, "a b c d e f g", 7, "x", 1, 2, "k"),
            (None, "a b c d e f g", 8, "x", 1, 2, "k"), (None, "one more text that stands alone here", 9, "x", 1, 2, "k"), (3, None, 10, "x", 1, 2, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, _text string, _key int, key int, row string")
    got = minhash.first_of_copies(docs)
    assert got.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert found == sorted([(1, "a b c d e f g"), (1, "quite another text of some words"), (None, "one more text that stands alone here"), (3, None)], key=str)
    assert all((r["_text"], r["_key"], r["key"], r["row"]) == ("x", 1, 2, "k") for r in got.collect())
    assert minhash.first_of_copies(docs.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
