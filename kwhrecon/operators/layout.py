"""Report projection, output labels, sheets and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.formats import format_document, sheet_title
from kwhrecon.functions.money import clamp_non_negative
from kwhrecon.functions.text import lower_strip
from kwhrecon.operators.grouping import LABEL_RULE

# Report columns (engine name, output label), in output order.
REPORT_COLUMNS = [
    ("unit_id", "Código Único da Unidade"),
    ("period", "Mês de Referência"),
    ("uc", "Instalação (UC)"),
    ("account", "Nº Conta"),
    ("doc", "CPF/CNPJ"),
    ("client", "Cliente (Razão Social)"),
    ("distributor", "Distribuidora"),
    ("consumed_credit", "Energia Compensada (kWh)"),
    ("contract_discount", "% Desconto Acordado"),
    ("due_date", "Data de Vencimento"),
    ("status", "Situação do Pagamento"),
    ("amount", "Fatura Raízen (R$)"),
    ("tariff", "Tarifa Aplicada (R$)"),
    ("cost_with_gd", "Custo c/ Desconto GD"),
    ("cost_without_gd", "Custo s/ Desconto GD"),
    ("savings", "Economia Gerada (R$)"),
    ("classification", "Tipo de Faturamento"),
]
REPORT_NAMES = [c for c, _ in REPORT_COLUMNS]
LAYOUT_COLUMNS = ["row_kind", "kind_rank", "group_ord", "ord"]
SINGLE_TABLE = "Tabela Única"
MULTI_SHEET = "Separadores Múltiplos"
MISSING_NOTE = "⚠ Dado ausente na Gestão de Cobrança para este período"


def report_projection(df: DataFrame, extra_cols=(), keep=()) -> DataFrame:
    """V1 + V3 + V6: the report columns in fixed order (absent -> null),
    the enrichment extras, the row-kind flags and layout columns."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in REPORT_NAMES]
    cols += [F.col(c) for c in extra_cols if c in df.columns]
    cols += [F.col(c) for c in list(keep) + LAYOUT_COLUMNS if c in df.columns and c not in REPORT_NAMES]
    out = df.select(*cols)
    kind = F.col("row_kind") if "row_kind" in out.columns else F.lit("normal")
    return out.withColumns({"is_parent": kind == "parent", "is_child": kind == "child",
                            "is_separator": kind == "separator"})


def output_values(df: DataFrame) -> DataFrame:
    """Writer formats: document mask (F19), negative tariff -> 0 (F20),
    text ids stripped."""
    cols = {}
    if "doc" in df.columns:
        cols["doc"] = format_document("doc")
    if "tariff" in df.columns:
        cols["tariff"] = clamp_non_negative("tariff")
    for c in ("account", "uc", "unit_id", "period"):
        if c in df.columns:
            cols[c] = F.btrim(F.col(c).cast("string"))
    return df.withColumns(cols)


def blank_separators(df: DataFrame) -> DataFrame:
    """Separators are written empty: every report column of theirs is null."""
    written = F.col("row_kind") != "separator"
    return df.withColumns({c: F.when(written, F.col(c)) for c in REPORT_NAMES if c in df.columns})


def label_columns(df: DataFrame, extra_cols=()) -> DataFrame:
    """V2: rename the report columns to their output labels."""
    labels = dict(REPORT_COLUMNS)
    return df.select(*[F.col(c).alias(labels.get(c, c)) for c in REPORT_NAMES + list(extra_cols)
                       if c in df.columns])


def audit_section(df: DataFrame) -> Column:
    """audit = child row or classified as a business rule."""
    child = F.col("row_kind") == "child" if "row_kind" in df.columns else F.lit(False)
    return F.when(child | (F.col("classification") == LABEL_RULE), F.lit("Aud")).otherwise(F.lit("Fin"))


def assign_sheets(df: DataFrame, presentation: str = SINGLE_TABLE, split_audit: bool = False) -> DataFrame:
    """K5 + P14 + F33: one sheet, or one per distributor (rows without a
    distributor -- separators included -- are not written); ``Fin - `` /
    ``Aud - `` prefixes when the audit split is on."""
    section = audit_section(df)
    prefix = F.concat(section, F.lit(" - ")) if split_audit else F.lit("")
    if presentation == SINGLE_TABLE:
        out = df.withColumn("sheet", F.concat(prefix, F.lit("Consolidado")))
    elif "distributor" in df.columns:
        out = df.filter(F.col("distributor").isNotNull()) \
            .withColumn("sheet", F.concat(prefix, F.col("distributor").cast("string")))
    else:
        out = df.withColumn("sheet", F.concat(prefix, F.lit("Faturas")))
    return out.withColumn("sheet", sheet_title("sheet"))


def missing_marks(df: DataFrame) -> DataFrame:
    """Flag non-separator rows whose due date or status is empty."""
    def empty(c: str) -> Column:
        if c not in df.columns:
            return F.lit(True)
        return F.col(c).isNull() | lower_strip(F.col(c).cast("string")).isin("", "nan", "nat", "none")
    sep = (F.col("row_kind") == "separator") if "row_kind" in df.columns else F.lit(False)
    mark = ~sep & (empty("due_date") | empty("status"))
    return df.withColumns({"missing_mark": mark,
                           "missing_note": F.when(mark, F.lit(MISSING_NOTE))})
