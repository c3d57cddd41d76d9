"""T1 scenarios."""

from pyspark.sql import functions as F

from kwhrecon.plans.consolidate import consolidate
from kwhrecon.operators import reconcile as R

BASE = ("row_id long, unit_id string, uc string, alt_uc string, period string, doc string, client string, "
        "distributor string, amount double")
CHG = ("charge_id long, uc string, period string, due_date string, status string, cancelled string, "
       "charged_amount string, account string, paid_date string, doc string")


def run(spark, base_rows, charge_rows):
    b = spark.createDataFrame(base_rows, BASE)
    c = spark.createDataFrame(charge_rows, CHG)
    res = consolidate(b, c, checkpoint=False)
    return res, {(r.src, r.row_id): r for r in res.consolidated.collect()}


def test_join_dot_zero_ids_and_cancelled(spark):
    base = [(1, "001", "42074274.0", None, "01/01/2026", "1111", "A", "X", 10.0),
            (2, "002", "5143128.0", None, "01/01/2026", "2222", "B", "X", 20.0)]
    ch = [(10, "42074274", "01-2026", "10-02-2026", "Em aberto", "Não", "100,00", "55.0", None, "1111"),
          (11, "5143128", "01-2026", "10-02-2026", "Pago", "Sim", "50,00", None, None, "2222")]
    res, rows = run(spark, base, ch)
    assert rows[(0, 1)].due_date == "10-02-2026" and float(rows[(0, 1)].charged_amount) == 100.0
    assert rows[(0, 1)].account == "55"
    # the cancelled charge is dropped but the base row stays, without a due date
    assert rows[(0, 2)].due_date is None and len(rows) == 2


def test_cancelled_before_dedupe_and_latest_due(spark):
    base = [(1, "001", "100", None, "01/2026", "1", "A", "X", 1.0)]
    ch = [(1, "100", "01-2026", "20/02/2026", "Pago", "Sim", "10,00", None, None, "1"),
          (2, "100", "01-2026", "10/02/2026", "Em aberto", "Não", "20,00", None, None, "1"),
          (3, "100", "01-2026", "15/02/2026", "Em aberto", "Não", "30,00", None, None, "1")]
    res, rows = run(spark, base, ch)
    r = rows[(0, 1)]
    assert r.due_date == "15/02/2026" and float(r.charged_amount) == 30.0 and r.is_dup


def test_month_must_match(spark):
    base = [(1, "001", "100", None, "01/2026", "1", "A", "X", 1.0)]
    ch = [(1, "100", "02-2026", "10/03/2026", "Pago", "Não", "10,00", None, None, "9")]
    res, rows = run(spark, base, ch)
    assert rows[(0, 1)].due_date is None
    gaps = {r.gap_type for r in res.gaps.collect()}
    assert gaps == {R.GAP_PERIOD}


def test_charges_without_months_join_by_unit(spark):
    base = spark.createDataFrame([(1, "n1", "81", None, "07/2031", "1", "A", "X", 1.0), (2, "n2", "82", None, "08/2031", "2", "B", "X", 2.0)], BASE)
    charges = spark.createDataFrame([(5, "81.0", "x", "05/08/2031", "Pago", "Não", "9,00", None, None, "1")], CHG).drop("period")
    rows = {r.row_id: r for r in consolidate(base, charges, checkpoint=False).consolidated.collect()}
    assert rows[1].due_date == "05/08/2031" and rows[2].due_date is None and len(rows) == 2


def test_gap_absent_unit(spark):
    base = [(1, "001", "777", None, "01/2026", "1", "A", "X", 1.0)]
    ch = [(1, "100", "01-2026", "10/02/2026", "Pago", "Não", "10,00", None, None, "9")]
    res, _ = run(spark, base, ch)
    assert [r.gap_type for r in res.gaps.collect()] == [R.GAP_ABSENT]


def test_fallback_alt_key_and_append_and_backfill(spark):
    base = [(1, "001", "100", "200.0", "01/2026", "11.111", "Cliente A", "CEMIG", 1.0),
            (2, "002", "300", None, "01/2026", "11111", "", None, 2.0)]
    ch = [(1, "200", "01-2026", "10/02/2026", "Pago", "Não", "170,71", None, None, "11111"),
          (2, "900.0", "01-2026", "11/02/2026", "Em aberto", "Não", "5,00", None, None, "11111"),
          (3, "901", "01-2026", "11/02/2026", "Em aberto", "Não", "5,00", None, None, "99999")]
    res, rows = run(spark, base, ch)
    # row 1 matched through its alternative unit
    assert float(rows[(0, 1)].charged_amount) == 170.71 and rows[(0, 1)].portal_uc == "200"
    # charge 2 (document of the base, no base row) is appended; charge 3 (unknown document) is not
    assert (1, 2) in rows and (1, 3) not in rows
    app = rows[(1, 2)]
    assert app.uc == "900" and app.source == "Fatura" and app.main_flag == "Y"
    assert app.period == "2026-01-01"


def test_identity_backfill_key_order(spark):
    df = spark.createDataFrame([
        (0, 1, "P1", None, "U1", "Donor One", "D1"),
        (0, 2, None, None, "u1", "", None),
        (0, 3, "p1", None, "X", None, None),
    ], "src int, row_id long, portal_uc string, alt_uc string, uc string, client string, distributor string")
    out = {r.row_id: r for r in R.identity_backfill(df, ["client", "distributor"]).collect()}
    assert out[2].client == "Donor One" and out[2].distributor == "D1"
    assert out[3].client == "Donor One"


def test_expansion_guard(spark):
    b = spark.createDataFrame([(1,)], "x int")
    c = spark.createDataFrame([(None,), (None,), (None,)], "due_date string")
    row = R.expansion_stats(b, c).first()
    assert row.rows == 3 and not row.guard_ok
