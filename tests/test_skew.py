"""Hot keys and late rows: results as before, and the plans they promise."""

import random

import pytest
from pyspark.sql import functions as F

from kwhrecon.operators import enrich as E
from kwhrecon.operators import grouping as G
from kwhrecon.operators import late
from kwhrecon.operators import portal as J
from kwhrecon.operators import reconcile as R
from kwhrecon.operators import skew


@pytest.fixture
def spread_out(spark):
    """As many shuffle tasks as partitions, whatever their size."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_found(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(5000)}", i) for i in range(30000)]
    df = spark.createDataFrame(rows, "k string, i long")
    hot = skew.hot_keys(df, ["k"])
    assert len(hot) <= skew.SHARE and spark.range(1).select(skew.key_hash([F.lit("hot")])).first()[0] in hot
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    assert len(skew.hot_groups(counts, ["k"], "n")) == 1
    assert skew.hot_keys(df.limit(0), ["k"]) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, spread_out, how):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"k{i % 50}", i % 2, i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, m int, i long")
    right = spark.createDataFrame([("hot", 0, "a"), ("k1", 1, "b"), ("k7", 1, "c"), ("absent", 0, "d")], "k string, m int, v string")
    got = skew.salted_join(left, right, ["k", "m"], skew.hot_keys(left, ["k", "m"]), how)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k", "m"], how).select(*got.columns).collect()))
    places = got.where("k = 'hot' and m = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert places >= 7


def test_one_group_of_a_third_spreads_over_all_tasks(spark, spread_out):
    rows = [(0, i, f"u{i}", "07/2031", "Padaria Umbu" if i % 3 == 0 else f"c{i % 400}", "Agrupamento", "Fatura", 1.5) for i in range(2400)]
    df = spark.createDataFrame(rows, "src int, row_id long, uc string, period string, client string, group_flag string, source string, amount double")
    df = df.withColumns({"ord": F.struct("src", "row_id"), "distributor": F.col("client")})
    out = G.apply_grouping(df, "distributor")
    hot = out.where("client = 'Padaria Umbu' and row_kind = 'child'").select(F.spark_partition_id().alias("p"))
    assert hot.count() == 800 and hot.distinct().count() >= 7
    parents = out.where("row_kind = 'parent' and client = 'Padaria Umbu'").collect()
    assert len(parents) == 1 and parents[0].amount == pytest.approx(1200.0) and parents[0].ord.row_id == 0
    few = G.apply_grouping(df, "distributor", include_child_rows=False)
    assert few.where("client = 'Padaria Umbu'").count() == 1
    assert plan(out).split("Initial Plan")[0].count("Scan ExistingRDD") == 2  # facts and members


def test_hot_identity_key_spreads(spark, spread_out):
    rows = [(0, i, None, None, "U1" if i % 3 == 0 else f"V{i % 300}", None if i > 2 else "Donor", None) for i in range(1500)]
    df = spark.createDataFrame(rows, "src int, row_id long, portal_uc string, alt_uc string, uc string, client string, distributor string")
    out = R.identity_backfill(df, ["client", "distributor"])
    want = {r.row_id: "Donor" if r.uc in ("U1", "V1", "V2") else None for r in df.collect()}
    assert {r.row_id: r.client for r in out.collect()} == want


def test_dedupe_aggregates_numbers(spark):
    rows = [(i, f"{i % 7}", "01-2031" if i % 5 else "02-2031", ["03/04/2031", None, "2031-05-06", "x"][i % 4], "Sim" if i % 6 == 0 else None, f"c{i:04d}") for i in range(200)]
    ch = spark.createDataFrame(rows, "n long, uc string, period string, due_date string, cancelled string, charge_id string").repartition(5)
    keyed = R.charge_keys(ch)
    got = R.dedupe_charges(keyed, active=R.active_charge())
    text = plan(got)
    assert "HashAggregate" in text and "SortAggregate" not in text
    best = {}
    for n, uc, period, due, cancelled, cid in rows:
        if cancelled != "Sim":
            rank = ({"03/04/2031": 0, "2031-05-06": -1}.get(due, 1), cid)
            key = (uc.lstrip("0"), period)
            count, low = best.get(key, (0, None))
            best[key] = (count + 1, min(low, rank) if low else rank)
    found = {(r.uc_key, r.period_month.strftime("%m-%Y")): (r.dup_count, r.charge_id) for r in got.collect() if r.dup_count}
    assert found == {k: (c, r[1]) for k, (c, r) in best.items()}


def test_keys_without_a_winner_stay(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False), (None, 4, True)], "k string, v int, ok boolean")
    got = late.best_rows(df, ["k"], [F.col("v").desc()], F.col("ok"), "n").collect()
    assert sorted(((r.k or "", r.v, r.n) for r in got), key=str) == [("", 4, 1), ("a", 1, 1), ("b", None, 0)]


def test_last_metadata_row(spark):
    df = spark.createDataFrame([("u1", "003", "x"), ("u1", "012", "y"), ("u2", "001", None), (None, "9", "z")], "uc string, seq string, tag string")
    out = E.keep_last(df)
    assert "SortAggregate" not in plan(out)
    assert sorted((str(r.uc), r.seq, r.tag) for r in out.collect()) == [("None", "9", "z"), ("u1", "012", "y"), ("u2", "001", None)]


def test_portal_rows_are_fetched_late(spark):
    """Preference: source, account, larger amount, then row order; ties of all but the order."""
    rng = random.Random(9)
    rows = [(0, i, f"{rng.randrange(12)}.0", f"0{1 + i % 3}/2031", float(rng.randrange(3)), None, rng.choice(["Fatura", "Contrato", None]),
             rng.choice([None, " ", "A1"]), rng.choice([None, 5.0, 7.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "src int, row_id long, uc string, period string, charged_amount double, portal_uc string, source string, account string, amount double")
    best = {}
    for _, i, uc, period, charged, _, source, account, amount in rows:
        if charged > 0:
            rank = (source != "Fatura", not (account or "").strip(), -(amount or 0), i)
            key = (uc.removesuffix(".0"), period)
            best[key] = min(best.get(key, rank), rank)
    out = J.restrict_to_portal(df.repartition(3))
    assert {(r.uc, r.period): r.row_id for r in out.collect()} == {k: r[3] for k, r in best.items()}
