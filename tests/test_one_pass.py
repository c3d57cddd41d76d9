"""The lookup of donors and the winners of the portal restriction carry an order once, with the rows of a minimum per column."""

import random

from pyspark.sql import functions as F

from kwhrecon.functions.keys import portal_uc, uc_text
from kwhrecon.operators import grouping as G
from kwhrecon.operators import portal as J
from kwhrecon.operators import reconcile as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_donors_carry_their_order_once(spark):
    rng, cols = random.Random(5), ["client", "doc", "distributor"]
    pick = lambda name, i: rng.choice([None, "", " \t", f"{name}{i}", f"{name}{i}", f"{name}{i}"])
    rows = [(rng.choice([0, 1]), rng.choice([f"r{i:03d}", f"r{i:03d}", None]) if i else None, *[pick(c, i) for c in cols], f"k{rng.randrange(25)}") for i in range(300)]
    rows = [r for n, r in enumerate(rows) if r[1] is not None or n == 0]  # the order of the rows is unique
    donors = spark.createDataFrame(rows, "src int, row_id string, client string, doc string, distributor string, _key string").repartition(4)
    found = R.first_donors(donors, cols)
    assert "min_by" not in plan(found).lower() and found.columns == ["_key", *["_lk_" + c for c in cols]]
    want = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        mine = want.setdefault(r[5], [None] * 3)
        for i in range(3):
            if mine[i] is None and r[2 + i] is not None and r[2 + i].strip():
                mine[i] = r[2 + i]
    assert {r[0]: list(r[1:]) for r in found.collect()} == want


def test_winners_carry_their_row_once(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 1]), f"r{i:03d}", f"{i % 40}", "01/2031", rng.choice(["Fatura", None]), rng.choice([5.0, 7.0]), i) for i in range(300)]
    scope = spark.createDataFrame(rows, "src int, row_id string, uc string, period string, source string, amount double, row_no long").repartition(4)
    won = J.portal_winners(scope, J.alias_map(scope))
    assert won.columns == ["row_no", "uc_final"] and "min_by" not in plan(won).lower()
    want = {}
    for r in rows:
        best = (r[4] != "Fatura", -r[5], r[0], r[1], r[6])
        want[r[2]] = min(want.get(r[2], best), best)
    assert {r.uc_final: r.row_no for r in won.collect()} == {k: v[-1] for k, v in want.items()}


def test_short_text_alone_is_lower_cased(spark):
    texts = [None, "", " ", "NaN", "nan ", "None", "NONE.0", "none", "nan.0", "nonen", "İ", "NAİN", "7.0", "ab", "nul", "NAN\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", portal_uc("t").alias("p"), uc_text("t").alias("u")).collect()
    bare = lambda s: s[:-2] if s.endswith(".0") else s
    for r in got:
        s = None if r.t is None else r.t.strip()
        assert r.p == (None if s is None or bare(s).lower() in ("", "nan", "none") else bare(s))
        assert r.u == (None if s is None or s.lower() in ("", "nan", "none") else bare(s))


def test_kinds_of_a_row_are_compiled(spark, sample_base):
    rows = sample_base.withColumn("ord", F.struct("src", "row_id"))
    for mode in ("default", "distributor", "cnpj"):
        out = G.apply_grouping(rows, mode)
        assert "Generate explode(_kinds" in plan(out)
        assert "_kinds" not in out.columns
