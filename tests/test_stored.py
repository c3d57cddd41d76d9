"""Indexes, bucketed tables, published folders, metadata in one call, row ids from files."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from kwhrecon.operators import filters as P
from kwhrecon.operators import index as I
from kwhrecon.operators import reconcile as R
from kwhrecon.operators import summary as S
from kwhrecon.plans import bucketed as B
from kwhrecon.plans import metadata as M
from kwhrecon.plans import sync as SY
from kwhrecon.plans.consolidate import write_consolidated
from kwhrecon.sources import folders
from kwhrecon.sources import sinks as K
from kwhrecon.sources.readers import read_export


def scratch():
    return tempfile.mkdtemp(prefix="kwhrecon-test-")


def test_indexed_search_equals_the_scan(spark):
    rng = random.Random(2)
    names = [None, "", "  ", "Ação & Cia.", "São  Paulo-Sul", "açaí", "ab", "a"] + ["".join(rng.choice("aáb cÇ-1") for _ in range(rng.randrange(25))) for _ in range(200)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, client string")
    path = os.path.join(scratch(), "index")
    I.build_search_index(df, "client", path)
    terms = [None, "", "!!", "ACAO", "sao paulo", "zzz"] + [n[k:k + size] for n in names[8:30] for k, size in ((0, 1), (1, 2), (0, 3), (2, 7), (0, 20)) if n[k:k + size]]
    for term in terms[:40]:
        want = {r.i for r in P.search_filter(df, "client", term).collect()}
        assert {r.i for r in I.search_indexed(df, "client", path, term).collect()} == want, term


def test_index_search_reads_its_grams_only(spark):
    path = os.path.join(scratch(), "index")
    I.build_search_index(spark.range(500).select(F.concat(F.lit("Cliente "), "id").alias("client")), "client", path)
    plan = I.search_values(spark, path, "liente 49")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_cube_answers_any_scope(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["1-1", "11", "", None, "2"]), rng.choice(["01/2031", "2031-02", "x", None]),
             rng.choice([None, "nan", "05/05/2031"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "client string, doc string, period string, due_date string")
    cube = I.scope_cube(df).cache()
    for _ in range(12):
        clients = rng.sample(["a", "b", "c", "zz"], rng.randrange(4))
        periods = rng.sample(["01/2031", "02-2031", "03/2031", "?"], rng.randrange(3))
        assert I.cube_metrics(cube, clients, periods).first() == S.review_metrics(P.filter_scope(df, clients, periods)).first()
    cube.unpersist()


def test_sketches_merge(spark):
    df = spark.range(20000).select(F.concat(F.lit("c"), F.col("id") % 5000).alias("client"), F.concat(F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lit("/2031")).alias("period"))
    row = I.sketched_metrics(I.month_sketches(df)).first()
    assert row.months == 12 and row.rows == 20000 and abs(row.clients - 5000) < 200


def test_bucketed_joins_shuffle_only_the_other_side(spark):
    rng = random.Random(3)
    base = spark.createDataFrame([(f"r{i:03d}", f"{rng.randrange(30)}", rng.choice([None, f"{rng.randrange(60)}"]), f"0{1 + i % 4}/2031") for i in range(200)],
                                 "row_id string, uc string, alt_uc string, period string")
    charges = spark.createDataFrame([(f"c{i:03d}", f"{i % 60}", f"0{1 + i % 4}/2031", "01/01/2031", "Pago", "5,00" if i % 3 else "0") for i in range(120)],
                                    "charge_id string, uc string, period string, due_date string, status string, charged_amount string")
    keyed, deduped = R.base_keys(base), R.dedupe_charges(R.charge_keys(charges))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b, c = B.store_bucketed(keyed, "t_base", 5), B.store_bucketed(deduped, "t_charges", 5)
        plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])[1]
        fields = [x for x in R.CHARGE_FIELDS if x in c.columns]
        assert "Exchange" not in plan(b.join(c.select(*R.KEYS, *fields), R.KEYS, "left"))
        out = B.join_bucketed(spark, "t_base", "t_charges")
        assert plan(out).count("Exchange hashpartitioning") == 1
        want = R.fallback_join(R.primary_join(keyed, deduped), deduped)
        cols = ["row_id", "uc_key", "charged_amount", "due_date", "portal_uc"]
        assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_stopped_overwrite_leaves_the_old_table(spark):
    path = os.path.join(scratch(), "table")
    rows = spark.createDataFrame([(0, "a", "1", None)], "src int, row_id string, uc_key string, period_month date")
    write_consolidated(rows, path)
    with pytest.raises(Exception):
        write_consolidated(rows.withColumn("row_id", F.raise_error(F.lit("stop")).cast("string")), path)
    assert [r.row_id for r in spark.read.parquet(path).collect()] == ["a"]
    write_consolidated(rows.withColumn("row_id", F.lit("b")), path)
    assert [r.row_id for r in spark.read.parquet(path).collect()] == ["b"]
    assert folders.exists(spark, f"{path}/_SUCCESS") and folders.folders_with(spark, os.path.dirname(path)) == [f"file:{path}"]


def test_import_file_order_and_replacement(spark):
    d = scratch()
    store = os.path.join(d, "profiles")
    K.save_profile(spark.createDataFrame([("1", "old", "t1"), ("2", "old", "t2")], "uc string, cost_center string, tag string"), store, "p")
    os.makedirs(os.path.join(d, "in"))
    with open(os.path.join(d, "in", "m.csv"), "w", encoding="utf-8-sig") as f:
        f.write(" Nº UC ;cost_center\n2.0;first\n3;x\n2;second\n;lost\n")
    got = M.import_metadata(spark, os.path.join(d, "in"), store, "p")
    assert sorted((r.uc, r.cost_center, r.tag) for r in got.collect()) == [("1", "old", "t1"), ("2", "second", None), ("3", "x", None)]
    M.import_metadata(spark, os.path.join(d, "in"), store, "p", replace_all=True)
    assert M.read_profiles(spark, store).where("profile = 'p'").count() == 3
    local = spark.createDataFrame([("9", "l", None, "q")], "uc string, cost_center string, tag string, profile string")
    out = M.import_metadata(spark, os.path.join(d, "in"), store, "q", local=local)
    assert sorted(r.uc for r in out.collect()) == ["2", "3", "9"]
    M.delete_profile(spark, store, "p")
    assert [r.profile for r in M.read_profiles(spark, store).select("profile").distinct().collect()] == ["q"]
    with pytest.raises(ValueError, match="no unit column"):
        with open(os.path.join(d, "bad.csv"), "w") as f:
            f.write("x;y\n1;2\n")
        M.import_metadata(spark, os.path.join(d, "bad.csv"), store, "p")


def test_documents(spark):
    docs = M.Documents(spark, os.path.join(scratch(), "docs"))
    docs.start(spark.createDataFrame([("1", "A", None), ("2", "B", "t")], "uc string, cost_center string, tag string"))
    docs.save(spark.createDataFrame([("2", None, "u"), ("3", "C", None)], "uc string, cost_center string, tag string"))
    docs.delete(spark.createDataFrame([("1",)], "uc string"))
    assert sorted((r.uc, r.cost_center, r.tag) for r in docs.current().collect()) == [("2", "B", "u"), ("3", "C", None)]


def test_ties_follow_the_files(spark):
    """Two charges of one unit and month with one due date: the first in the files wins; the first named donor fills blanks."""
    d = scratch()
    for sub, name, text in (("b", "1.csv", "x\nNo. UC;CPF/CNPJ;Referencia;Razao Social\nU7;1;07/2031;Zulu\nU7;1;08/2031;\nU7;1;09/2031;Alfa\n"),
                            ("c", "2.csv", "Instalação;Mês de referência;Vencimento;Valor da cobrança\nU7;07/2031;05/08/2031;9,00\nU7;07/2031;05/08/2031;1,00\n"),
                            ("c", "1.csv", "Instalação;Mês de referência;Vencimento;Valor da cobrança\nU7;07/2031;05/08/2031;5,00\n")):
        os.makedirs(os.path.join(d, sub), exist_ok=True)
        with open(os.path.join(d, sub, name), "w") as f:
            f.write(text)
    base, charges = read_export(spark, os.path.join(d, "b")), read_export(spark, os.path.join(d, "c"), markers=["Instalação"])
    rows = {r.period: r for r in SY.sync(base, charges, os.path.join(d, "t"), os.path.join(d, "g")).collect()}
    assert float(rows["07/2031"].charged_amount) == 5.0 and rows["08/2031"].client == "Zulu"


def test_outputs_from_one_run_of_the_report(spark, sample_base):
    """The report is computed once; marks, totals and counts come with it; an older output is replaced as a whole."""
    from kwhrecon.plans import report as RP
    path = os.path.join(scratch(), "out")
    os.makedirs(path)
    open(os.path.join(path, "stale"), "w").close()
    seen = spark.sparkContext.accumulator(0)
    rows = sample_base.withColumns({"charged_amount": F.col("amount"), "portal_uc": F.lit(None).cast("string")})
    rep = RP.generate(rows, [], [], None, RP.ReportOptions(as_of="2031-08-06", checkpoint=False))
    counted = spark.createDataFrame(rep.rdd.map(lambda r: (seen.add(1), r)[1]), rep.schema)
    n = rep.count()
    K.write_outputs(counted, path)
    assert seen.value == n and not os.path.exists(os.path.join(path, "stale"))
    counts = {r.status: r["count"] for r in spark.read.json(os.path.join(path, "status")).collect()}
    assert counts == {r.status: r["count"] for r in S.status_counts(rep).collect()}
