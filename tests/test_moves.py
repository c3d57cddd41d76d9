"""What the consolidation does not move: losing charges, rows that need no second lookup, sides that lie by their key."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from kwhrecon import session
from kwhrecon.operators import late
from kwhrecon.operators import reconcile as R
from kwhrecon.operators import skew


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture
def kept(monkeypatch):
    """The tables written during the test."""
    written = []
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: written.append(name) or os.path.join(tempfile.mkdtemp(prefix="run-"), name))
    return written


def test_losing_charges_are_neither_stored_nor_moved(spark, kept):
    rows = [("hot" if i % 3 else f"k{i}", i, i % 5 != 0) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, ok boolean").repartition(6)
    out = late.best_rows(df, ["k"], [F.col("v").desc()], F.col("ok"), "n")
    assert plan(out).count("WindowGroupLimit") == 2  # before the shuffle and after it
    assert kept == []
    want = {}
    for k, v, ok in rows:
        best, n = want.get(k, (None, 0))
        want[k] = (max(v, -1 if best is None else best), n + 1) if ok else (best, n)
    assert {r.k: (r.v, r.n) for r in out.collect()} == want


def test_null_keys_of_each_kind_are_keys(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 3), ("", None, 2), (None, 0, 5), ("", 0, 4), ("", 0, 6)], "a string, b int, v int")
    out = late.best_rows(df, ["a", "b"], [F.col("v").desc()], F.lit(True), "n")
    assert {(r.a, r.b): (r.v, r.n) for r in out.collect()} == {(None, None): (3, 2), ("", None): (2, 1), (None, 0): (5, 1), ("", 0): (6, 2)}
    assert out.columns == ["a", "b", "v", "n"]


def test_keys_without_a_hot_one_join_plainly(spark):
    df = spark.range(20000).select(F.concat(F.lit("u"), F.col("id")).alias("k"))
    assert skew.hot_keys(df, ["k"]) == []
    some = df.unionByName(spark.range(300).select(F.lit("x").alias("k")))
    assert skew.hot_keys(some, ["k"]) == [spark.range(1).select(skew.key_hash([F.lit("x")])).first()[0]]


def test_only_rows_that_ask_again_join_again(spark):
    rng = random.Random(5)
    base = spark.createDataFrame([(f"r{i:03d}", f"{rng.randrange(30)}", rng.choice([None, "", f"{rng.randrange(60)}"]), rng.choice(["01/2031", "02/2031", "x"]))
                                  for i in range(200)], "row_id string, uc string, alt_uc string, period string")
    charges = spark.createDataFrame([(f"c{i:03d}", f"{i % 50}", f"0{1 + i % 2}/2031", "01/01/2031" if i % 7 else None, "Pago", ["5,00", "0", "-1,00", "x"][i % 4])
                                     for i in range(150)], "charge_id string, uc string, period string, due_date string, status string, charged_amount string")
    deduped = R.dedupe_charges(R.charge_keys(charges))
    joined = R.primary_join(R.base_keys(base), deduped)
    for rows in (joined, joined.drop("charged_amount")):
        asking, rest = R.fallback_split(rows)
        assert 0 < asking.count() < 200
        got = rest.unionByName(R.fallback_join(asking, deduped)).select(*rows.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, R.fallback_join(rows, deduped).select(*rows.columns).collect()))
    none = joined.drop("alt_key")
    assert R.fallback_split(none)[0].count() == 0 and R.fallback_split(none)[1].count() == 200
