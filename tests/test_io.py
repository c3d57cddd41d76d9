"""Sources, sinks and the incremental refresh, round-tripped through a scratch folder."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from kwhrecon.plans import tables as T
from kwhrecon.plans.consolidate import consolidate
from kwhrecon.sources import readers as S
from kwhrecon.sources import sinks as K
from kwhrecon.streaming.refresh import start_refresh

SF = "/root/testdata/sf0.001"


def scratch():
    return tempfile.mkdtemp(prefix="kwhrecon-test-")


def test_header_scan_and_body(spark):
    d = scratch()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("junk\nmore junk;x\n;;\n\n\nNo. UC ; CPF/CNPJ;Razao Social\nUC1;111;A\nUC2;222;B\n")
    with open(os.path.join(d, "b.csv"), "w", encoding="utf-8-sig") as f:
        f.write("No. UC;CPF/CNPJ\nUC9;\"9;99\"\n")
    pos = {os.path.basename(r.file): r.header_line for r in S.header_positions(spark, d).collect()}
    assert pos == {"a.csv": 5, "b.csv": 0}
    body = S.read_with_header(spark, d)
    assert sorted((r.cells[0], r.cells[1]) for r in body.collect()) == [("UC1", "111"), ("UC2", "222"), ("UC9", "9;99")]
    assert {tuple(r.header)[:2] for r in S.header_cells(spark, d).collect()} == {("No. UC", "CPF/CNPJ")}


def test_aliases_and_csv(spark):
    d = scratch()
    with open(os.path.join(d, "m.csv"), "w", encoding="utf-8-sig") as f:
        f.write("Instalação;Número da conta ;Mês de Referência\n123.0;55.0;01-2026\n")
    df = S.trim_columns(S.read_semicolon_csv(spark, d))
    assert df.columns == ["Instalação", "Número da conta", "Mês de Referência"]
    r = S.resolve_aliases(df).first()
    assert (r.uc, r.account, r.period) == ("123.0", "55.0", "01-2026")


def test_export_blocks_and_line_ends(spark):
    """Files of many blocks and of CRLF lines: nothing above the header comes through, everything below does, in file order, without a shuffle."""
    d = scratch()
    with open(os.path.join(d, "a.csv"), "w", newline="") as f:
        f.write("junk\r\nNo. UC;CPF/CNPJ\r\n" + "".join(f"U{i:05d};{i}\r\n" for i in range(3000)))
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("CPF/CNPJ;No. UC;Razao Social\n" + "".join(f"{i};V{i};\n" for i in range(40)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = S.read_export(spark, d)
        got = rows.orderBy("file", "block", "n").collect()
        assert [r["No. UC"] for r in got] == [f"U{i:05d}" for i in range(3000)] + [f"V{i}" for i in range(40)]
        assert [r["CPF/CNPJ"] for r in got[:3000]] == [str(i) for i in range(3000)] and got[-1]["Razao Social"] is None
        assert len({r.block for r in got}) > 5
        body = S.read_with_header(spark, d)
        body.collect()
        assert "Exchange hashpartitioning" not in body._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_required_columns_and_pruned_scan(spark):
    d = os.path.join(scratch(), "t")
    spark.createDataFrame([("a", 1, 2.0)], "` uc ` string, n int, other double").write.json(d)
    assert S.pruned_scan(spark, d, ["uc", "n"], fmt="json").columns == ["uc", "n"]
    assert sorted(S.pruned_scan(spark, d, ["absent"], fmt="json").columns) == ["n", "other", "uc"]
    with pytest.raises(ValueError, match="missing required columns.*periodo"):
        S.require_columns(spark.range(1), ["id", "periodo"])
    with pytest.raises(ValueError, match="no header line"):
        bad = scratch()
        with open(os.path.join(bad, "x.csv"), "w") as f:
            f.write("a;b\n")
        S.read_with_header(spark, bad)


def test_document_folder(spark):
    d = scratch()
    for unit, text in (("u-1", '{"tag": "x", "n": 1}'), ("u2", '{"cost_center": "C"}')):
        with open(os.path.join(d, unit + ".json"), "w") as f:
            f.write(text)
    got = {r.uc: (r.tag, r.cost_center) for r in S.read_documents(spark, d).collect()}
    assert got == {"u-1": ("x", None), "u2": (None, "C")}


def test_latest_snapshot_and_profile(spark):
    d = scratch()
    spark.range(50).repartition(4).write.parquet(os.path.join(d, "2030"))
    spark.range(90).repartition(6).write.parquet(os.path.join(d, "2031"))
    spark.range(7).write.parquet(os.path.join(d, "2032"))
    os.rename(os.path.join(d, "2032", "_SUCCESS"), os.path.join(d, "2032", "_STARTED"))
    assert S.latest_snapshot(spark, d).count() == 90
    with pytest.raises(FileNotFoundError):
        S.latest_snapshot(spark, scratch())
    prim = spark.createDataFrame([("p1", "u")], "profile string, uc string")
    loc = spark.createDataFrame([("p1", "v"), ("p2", "w")], "profile string, uc string")
    assert sorted((r.profile, r.uc) for r in S.load_profile(prim, loc).collect()) == [("p1", "u"), ("p2", "w")]


def test_sinks_round_trip(spark):
    d = scratch()
    res = consolidate(T.base(spark, SF), T.charges(spark, SF))
    K.write_consolidated(res.consolidated, os.path.join(d, "cons"))
    back = spark.read.parquet(os.path.join(d, "cons"))
    assert back.count() == res.consolidated.count()
    K.write_gap_report(res.gaps, os.path.join(d, "gaps"), "2026-01-01T00:00:00")
    hdr = spark.read.json(os.path.join(d, "gaps", "header")).first()
    assert hdr.total_ucs_sem_vencimento == res.gaps.count()
    groups = K.save_client_group(T.groups(spark, SF), 900, "Grupo_900", ["A", "B", "A"])
    assert groups.filter(F.col("group_id") == 900).count() == 2


def test_refresh_equals_full_run_after_a_replay(spark):
    from kwhrecon.streaming.refresh import refresh_batch
    d = scratch()
    base, ch = T.base(spark, SF), T.charges(spark, SF)
    src, store, out = (os.path.join(d, x) for x in ("incoming", "store", "cons"))
    early, late = ch.filter("charge_id < '000000000001000'"), ch.filter("charge_id >= '000000000001000'")
    early.write.parquet(src)
    start_refresh(spark, src, ch.schema, base, store, out, os.path.join(d, "ckpt")).awaitTermination()
    for _ in range(2):  # the same batch twice
        refresh_batch(spark, late, 1, base, store, out)
    got, full = spark.read.parquet(out), consolidate(base, ch).consolidated
    key = ["src", "row_id", "due_date", "client", "doc", "is_dup"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, full.select(*key).collect()))


def test_write_report_partitions(spark):
    from kwhrecon.plans import report as RP
    d = scratch()
    cons = consolidate(T.base(spark, SF), T.charges(spark, SF)).consolidated
    rep = RP.generate(cons, [], [], None, RP.ReportOptions(as_of="1996-06-01", grouping_mode="distributor",
                                                            presentation="Separadores Múltiplos"))
    K.write_report(rep, os.path.join(d, "out"), by=("sheet",))
    back = spark.read.option("header", True).csv(os.path.join(d, "out"))
    assert back.count() == rep.count()
    assert back.select("sheet").distinct().count() == rep.select("sheet").distinct().count()


def test_write_outputs(spark, sample_base):
    from kwhrecon.operators.layout import REPORT_COLUMNS
    from kwhrecon.plans import report as RP
    d = scratch()
    rows = sample_base.withColumns({"charged_amount": F.col("amount"), "portal_uc": F.lit(None).cast("string")})
    rep = RP.generate(rows, [], [], None, RP.ReportOptions(as_of="2031-08-06", checkpoint=False))
    assert all(r[c] is None for r in rep.filter("row_kind = 'separator'").collect() for c, _ in REPORT_COLUMNS)
    K.write_outputs(rep, os.path.join(d, "out"))
    back = spark.read.option("header", True).csv(os.path.join(d, "out", "rows"))
    assert back.columns == [label for _, label in REPORT_COLUMNS] + ["sheet"] and back.count() == rep.count()
    total = spark.read.json(os.path.join(d, "out", "summary")).first()
    assert total.amount_total == pytest.approx(61.10 + 72.20 + 66.30 + 15.05 + 14.95 + 33.0 + 5.5)
    broken = rep.withColumn("status", F.lit("outro"))
    with pytest.raises(ValueError, match="payment rules"):
        K.write_outputs(broken, os.path.join(d, "none"))
    assert not os.path.exists(os.path.join(d, "none"))


def test_month_filter_prunes_partitions(spark):
    from kwhrecon.operators.filters import period_scope
    d = scratch()
    cons = consolidate(T.base(spark, SF), T.charges(spark, SF)).consolidated
    from kwhrecon.sources.sinks import write_consolidated
    write_consolidated(cons, os.path.join(d, "cons"))
    table = spark.read.parquet(os.path.join(d, "cons"))
    scoped = period_scope(table, ["01/1997", "1997-02", "13/1997"])
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "period_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert scoped.count() == period_scope(cons, ["01/1997", "1997-02", "13/1997"]).count()


def test_profile_sinks(spark):
    from kwhrecon.operators import enrich as E
    d = scratch()
    p1 = spark.createDataFrame([("1", "A"), ("2", "B")], "uc string, cost_center string")
    K.save_profile(p1, os.path.join(d, "profiles"), "alpha")
    K.save_profile(p1.limit(1), os.path.join(d, "profiles"), "beta")
    K.save_profile(spark.createDataFrame([("9", "Z")], "uc string, cost_center string"), os.path.join(d, "profiles"), "alpha")
    back = spark.read.parquet(os.path.join(d, "profiles"))
    assert sorted((r.profile, r.uc) for r in back.collect()) == [("alpha", "9"), ("beta", "1")]
    upd = spark.createDataFrame([("2", None, "t"), ("3", "C", None)], "uc string, cost_center string, tag string")
    K.merge_write(p1, upd, os.path.join(d, "merged"))
    m = {r.uc: r for r in spark.read.parquet(os.path.join(d, "merged")).collect()}
    assert m["2"].cost_center == "B" and m["2"].tag == "t" and m["3"].cost_center == "C"
    K.delete_write(p1, spark.createDataFrame([("1",)], "uc string"), os.path.join(d, "deleted"))
    assert [r.uc for r in spark.read.parquet(os.path.join(d, "deleted")).collect()] == ["2"]
    names = E.profile_names(back.select("profile"), spark.createDataFrame([("gamma",), ("alpha",)], "profile string"))
    assert [r.profile for r in names.collect()] == ["alpha", "beta", "gamma"]
