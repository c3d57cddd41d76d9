"""Grouping, portal restriction, scope filters and payment rules."""

import pytest
from pyspark.sql import functions as F

from kwhrecon.operators import filters as P
from kwhrecon.operators import grouping as G
from kwhrecon.operators import payment as C
from kwhrecon.operators import portal as J
from kwhrecon.plans import report as RP


def grouped(df, mode="default", **kw):
    df = df.withColumn("ord", F.struct("src", "row_id"))
    return G.apply_grouping(df, mode, has_commercial=False, **kw)


def test_flagged_pair_gets_a_parent_with_sums(sample_base):
    g = grouped(sample_base.filter(F.col("client") == "Mercado Cedro"))
    rows = sorted(g.collect(), key=lambda r: (r.kind_rank, r.row_id or 0))
    assert len(rows) == 4
    parent = rows[0]
    assert parent.row_kind == "parent" and parent.uc == "Consolidado (Default)"
    assert parent.amount == pytest.approx(30.0) and parent.consumed_credit == pytest.approx(60.0)
    assert [r.row_kind for r in rows[1:]] == ["child", "child", "separator"]


def test_every_group_ends_with_a_separator(sample_base):
    g = grouped(sample_base)
    kinds = [r.row_kind for r in g.collect()]
    assert len(kinds) == 14 and kinds.count("parent") == 1 and kinds.count("separator") == 6


def test_lonely_flagged_unit_no_parent(sample_base):
    g = grouped(sample_base.filter((F.col("client") == "Escola Angico") & F.col("group_flag").isNotNull()))
    assert sorted(r.row_kind for r in g.collect()) == ["normal", "separator"]


def test_rows_without_month_stay_flat(sample_base):
    g = grouped(sample_base.drop("period"), "distributor", include_child_rows=False)
    assert {r.row_kind for r in g.collect()} == {"normal"} and g.count() == sample_base.count()


def test_cnpj_mode_groups_without_flag(sample_base):
    g = grouped(sample_base.filter(F.col("client") == "Mercado Cedro"), "cnpj")
    assert sum(r.row_kind == "parent" for r in g.collect()) == 1


def test_no_children_and_majority(sample_base):
    g = grouped(sample_base.filter(F.col("client") == "Mercado Cedro"), include_child_rows=False)
    kinds = sorted(r.row_kind for r in g.collect())
    assert kinds == ["parent", "separator"]
    full = grouped(sample_base.filter(F.col("client") == "Mercado Cedro"))
    parent = [r for r in full.collect() if r.row_kind == "parent"][0]
    # one Fatura out of two children is no majority
    assert parent.classification == "Regra de Negócio"


def test_document_expansion(spark):
    df = spark.createDataFrame([("Ipê", "40.000.000/0001-11", "a"), ("Ipê filial", "40000000000111", "b"), ("Ipê", None, "c"),
                                ("Cedro", "40000000000333", "d"), (None, "40000000000111", "e"), (None, None, "f")],
                               "client string, doc string, uc string")
    assert sorted(r.uc for r in P.client_scope(df, ["Ipê"]).collect()) == ["a", "b", "c", "e"]
    assert P.client_scope(df, []).count() == 6


def test_period_scope_invalid_list_keeps_nothing(spark):
    df = spark.createDataFrame([("01/2026",), ("2026-01",)], "period string")
    assert P.period_scope(df, ["01/2026"]).count() == 2
    assert P.period_scope(df, ["N/A"]).count() == 0
    assert P.period_scope(df, []).count() == 2


def test_positive_charge_takes_numbers_only(spark):
    df = spark.createDataFrame([(1, "3.5"), (2, "0"), (3, "-1"), (4, "abc"), (5, None), (6, "NaN")], "i int, charged_amount string")
    assert [r.i for r in df.filter(P.positive_charge()).collect()] == [1]


def test_portal_restriction(spark):
    df = spark.createDataFrame([
        (0, 1, "50917", "08/2033", 41.0, None, "Fatura", "C7", 3.0),
        (0, 2, "50917", "08/2033", 77.0, None, "Contrato", None, 8.0),
        (0, 3, "60", "08/2033", None, None, "Fatura", None, 2.0),
        (0, 4, "61", "08/2033", 0.0, None, "Fatura", None, 2.0),
        (0, 5, "K4410099", "09/2033", 15.0, "50917", "Fatura", None, 2.0),
    ], "src int, row_id long, uc string, period string, charged_amount double, portal_uc string, "
       "source string, account string, amount double")
    out = {r.row_id: r for r in J.restrict_to_portal(df).collect()}
    assert set(out) == {1, 5}
    assert out[1].amount == 41.0 and out[1].uc == "K4410099"


def test_payment_rules(spark):
    df = spark.createDataFrame([
        ("Acordo firmado", "2026-01-10", None, "01/2026"), ("não pago", None, None, "01/2026"),
        ("Em aberto", "2026-01-10", "15/01/2026", None), ("x", "2026-01-10", None, "01/2026"),
        ("x", "2026-03-10", "-", "99/9999"),
    ], "status string, due_date string, paid_date string, period string")
    out = C.payment_rules(df, as_of="2026-02-01").collect()
    assert [r.status for r in out] == ["Negociado", "Pago", "Pago", "Atrasado", "Em aberto"]
    assert [r.paid_date for r in out] == [None, "", "15-01-2026", None, None]
    assert out[1].due_date == "Não disponível" and out[2].period is None and out[4].period == "99/9999"
    C.check_payment_rules(C.payment_rules(df, as_of="2026-02-01"))


def test_report_invariant_to_partitions(spark, sample_base):
    base = sample_base.withColumns({"charged_amount": F.col("amount"), "portal_uc": F.lit(None).cast("string")})
    sums = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        r = RP.flat_report(RP.generate(base.repartition(n), [], [], None,
                                       RP.ReportOptions(as_of="2026-02-01", checkpoint=False)))
        sums.append(sorted((r.row_kind, r.client or "", r.amount or 0.0) for r in r.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sums[0] == sums[1]
