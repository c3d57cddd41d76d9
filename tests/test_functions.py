"""Column builders against tables of values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kwhrecon.functions import dates as D
from kwhrecon.functions import formats as FM
from kwhrecon.functions import keys as K
from kwhrecon.functions import money as M


def one(spark, col_fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("v"))).collect()]


def test_parse_full_date(spark):
    d = dt.date
    table = {"2031-08-23": d(2031, 8, 23), "2031-08-23 07:45:10": d(2031, 8, 23), "23/08/2031": d(2031, 8, 23), "07-09-2033": d(2033, 9, 7), "N/A": None, "": None,
             None: None, "sem vencimento": None, "28/02/2032": d(2032, 2, 28), "02/28/2032": d(2032, 2, 28), "11-2034": d(2034, 11, 1), "20330917": d(2033, 9, 17),
             "17.09.2033": d(2033, 9, 17), "19-09-2033 21:15": d(2033, 9, 19), "3/4/31": d(2031, 4, 3), "3/4/71": d(1971, 4, 3), "2031-08-23abc": None, "2031-06-31": None,
             "2035/10": d(2035, 10, 1), "2035-10": d(2035, 10, 1), "Sep-2034": d(2034, 9, 1), "27 Oct 2034": d(2034, 10, 27), "Bar 2034": None, "nat": None}
    assert one(spark, D.parse_full_date, list(table)) == list(table.values())


def test_reference_period(spark):
    table = {"09/2032": "09-2032", "10-2033": "10-2033", "2034-11": "11-2034", "2034-11-30": "11-2034", "30/11/2034": "11-2034", "n/a": None, "": None, None: None, "77/7777": "77-7777"}
    assert one(spark, D.parse_reference_period, list(table)) == list(table.values())
    assert one(spark, D.format_reference_period, list(table)[:6]) == ["09/2032", "10/2033", "11/2034", "11/2034", "11/2034", "Não disponível"]
    assert one(spark, D.period_month, ["77/7777", "14-2033", "09/2032"]) == [None, None, dt.date(2032, 9, 1)]


def test_format_full_date(spark):
    assert one(spark, D.format_full_date, ["2031-08-23", "7/9/2033", "--", None]) == ["23-08-2031", "07-09-2033", "Não disponível", "Não disponível"]


def test_period_sort_key(spark):
    df = spark.createDataFrame([("08/2033",), ("11/2032",), ("15/2032",), ("03/2033",)], "p string")
    got = [r.p for r in df.orderBy(D.period_sort_key("p")).collect()]
    assert got == ["11/2032", "03/2033", "08/2033", "15/2032"]


def test_unit_keys(spark):
    vals = ["70310055.0", " 000918273.0 ", "K4410099", None, "nan", "pqr.0"]
    assert one(spark, K.uc_key, vals) == ["70310055", "918273", "4410099", "", "", ""]
    assert one(spark, K.portal_uc, vals) == ["70310055", "000918273", "K4410099", None, None, "pqr"]
    assert one(spark, K.uc_text, [".0", "NaN", "61.0"]) == ["", None, "61"]
    assert one(spark, K.identity_key, ["0093.0", "k-44.10", None]) == ["0093", "K4410", ""]
    assert one(spark, K.doc_digits, ["40.500.600/0007-81", None]) == ["40500600000781", ""]
    assert one(spark, K.contains_letter, ["905", "K9", None]) == [False, True, False]
    assert one(spark, K.account_text, ["3081.0", "0045.0", "pqr.0", "66", None]) == ["3081", "45", "pqr", "66", None]
    assert one(spark, K.group_key_text, [" norte luz ", "none", "", None]) == ["NORTE LUZ", "N/A", "N/A", "N/A"]


def test_br_numbers(spark):
    vals = ["7.654,30", "88,09", "7654.30", "--", "", None, "pqr", " 41 ", "0,417265", "9.250,125", "2e3"]
    got = [None if v is None else float(v) for v in one(spark, M.br_number, vals)]
    assert got == [7654.30, 88.09, 7654.30, None, None, None, None, 41.0, 0.417265, 9250.125, 2000.0]
    strict = [None if v is None else float(v) for v in one(spark, lambda c: M.charge_money(c, strict_br=True), vals[:3])]
    assert strict == [7654.30, 88.09, 765430.0]
    assert one(spark, M.clamp_non_negative, [-0.25, 0.41, None], "double") == [0.0, 0.41, None]


def test_documents_and_titles(spark):
    assert one(spark, FM.format_document, ["40500600000781", "70180190217", "65", None]) == ["40.500.600/0007-81", "701.801.902-17", "00.000.000/0000-65", None]
    assert one(spark, FM.sheet_title, ["Aud - N/S:L*O?[y]", ""]) == ["Aud - NSLOy", "Consolidado"]


def test_names(spark):
    assert one(spark, FM.period_token, ["2031-07-01", "11/2030", "um dois"]) == ["jul_2031", "nov_2030", "um_dois"]
    df = spark.createDataFrame([
        (0, "Grupo_7", ["Padaria Ipê", "Mercado Cedro"], ["07/2031"]),
        (1, "Grupo_8", ["Escola"], []),
        (2, "Rede Sul", ["Escola"], ["07/2031", "08/2031"]),
        (3, "Rede_jul_2031", ["Escola"], ["09/2031"]),
        (4, "", [], ["09/2031"]),
    ], "i int, n string, c array<string>, p array<string>")
    got = df.orderBy("i").select(FM.suggested_name("n", F.col("c"), F.col("p")).alias("s"), FM.output_file_name("n", F.col("c"), F.col("p")).alias("o"),
                                 FM.zip_entry_name("n", F.col("c"), F.coalesce(F.try_element_at("p", F.lit(1)), F.lit("07/2031"))).alias("z")).collect()
    assert [r.s for r in got] == ["Padaria_Ip_e_outros_jul_2031", "Escola", "Rede_Sul_jul_ago_2031", "Rede_set_2031", "Memoria_Calculo_set_2031"]
    assert [r.o for r in got] == ["Padaria_Ip_e_outros_jul_2031.xlsx", "Escola.xlsx", "Rede_Sul.xlsx", "Rede_jul_2031.xlsx", "Sem_Nome.xlsx"]
    assert [r.z for r in got][:4] == ["Padaria_Ip_e_outros_jul_2031.xlsx", "Escola_jul_2031.xlsx", "Rede_Sul_jul_2031.xlsx", "Rede_set_2031.xlsx"]
    p = spark.createDataFrame([(["12/2025", "01/2026"],), (["02/2026", "01/2026"],)], "p array<string>")
    assert [r[0] for r in p.select(FM.periods_suffix(F.col("p"))).collect()] == ["dez_2025_jan_2026", "jan_fev_2026"]


def test_search_normalize(spark):
    assert one(spark, FM.search_normalize, ["  Ação  São-Paulo!! ", None]) == ["acao sao paulo", ""]
