"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.dates import normalize_period_value, period_sort_key
from kwhrecon.functions.money import br_number
from kwhrecon.operators.filters import exclude_kinds, incomplete


def summary_totals(report: DataFrame) -> DataFrame:
    """Sums of savings and billed amount over non-parent, non-separator rows."""
    rows = exclude_kinds(report) if "row_kind" in report.columns else report
    t = dict(rows.dtypes)
    return rows.agg(
        F.coalesce(F.sum(br_number("savings", 0, dtype=rows.schema["savings"].dataType)), F.lit(0))
        .cast("double").alias("savings_total"),
        F.coalesce(F.sum(br_number("amount", 0, dtype=rows.schema["amount"].dataType)), F.lit(0))
        .cast("double").alias("amount_total"),
    ) if "savings" in t else rows.agg(F.lit(0.0).alias("savings_total"))


def status_counts(report: DataFrame) -> DataFrame:
    """A8 + O8: rows per status (non-parent, non-separator), most frequent first."""
    rows = exclude_kinds(report) if "row_kind" in report.columns else report
    return (rows.filter(F.col("status").isNotNull()).groupBy("status")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "status"))


def review_metrics(scope: DataFrame, due: str = "due_date") -> DataFrame:
    """A5 + A6: total and incomplete rows of a scope (one row)."""
    inc = F.count_if(incomplete(due)) if due in scope.columns else F.lit(0)
    return scope.agg(F.count(F.lit(1)).alias("total_rows"), inc.cast("bigint").alias("incomplete_rows"))


def incomplete_rows(scope: DataFrame, due: str = "due_date") -> DataFrame:
    """A6 detail: unit, month and client of the rows without a due date."""
    return scope.filter(incomplete(due)).select(
        F.col("uc").cast("string").alias("no_uc"), F.col("period").cast("string").alias("referencia"),
        F.col("client").alias("razao_social"))


def dataset_metrics(df: DataFrame) -> DataFrame:
    """Distinct clients, distinct valid months, rows."""
    month = normalize_period_value("period")
    return df.agg(F.count_distinct("client").alias("clients"),
                  F.count_distinct(F.when(month != "", month)).alias("months"),
                  F.count(F.lit(1)).alias("rows"))


def clients(df: DataFrame) -> DataFrame:
    """A17 + O2: distinct non-null clients in code-point order."""
    return df.select(F.col("client").cast("string").alias("client")).dropna().distinct().orderBy("client")


def periods(df: DataFrame) -> DataFrame:
    """A18 + O1: distinct valid months (``MM/yyyy``), chronological, invalid last."""
    m = df.select(normalize_period_value("period").alias("period")).filter(F.col("period") != "").distinct()
    key = period_sort_key("period")
    return m.withColumns({"sort_year": key["year"], "sort_month": key["month"]}) \
        .orderBy("sort_year", "sort_month", "period")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, the null group included."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def multi_unit_docs(df: DataFrame) -> DataFrame:
    """Documents with more than one unit per distributor."""
    return (df.groupBy("doc", "distributor").agg(F.count_distinct("uc").alias("units"))
            .filter(F.col("units") > 1))


def flagged_counts(df: DataFrame, flag_col: str = "group_flag", flag_value: str = "Agrupamento") -> DataFrame:
    """Non-null / condition counts on the flagged subset."""
    sub = df.filter(F.col(flag_col) == flag_value)
    return sub.agg(F.count(F.lit(1)).alias("rows"),
                   F.count("alt_uc").alias("with_alt_uc"),
                   F.count_if(F.col("main_flag") == "Y").alias("main_rows"),
                   F.count("commercial_id").alias("with_commercial_id"))


def unit_client_pairs(df: DataFrame) -> DataFrame:
    """Distinct (unit, client), ordered by client."""
    return df.select("uc", "client").distinct().orderBy("client", "uc")


# Columns that are text by contract and never converted (A10).
PROTECTED_TEXT = {"client", "distributor", "status", "uc", "doc", "period", "group_flag",
                  "due_date", "account", "unit_id", "alt_uc", "portal_uc", "contract_discount"}
_NUMERIC_TEXT = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def type_inference_stats(df: DataFrame, threshold: float = 0.8, protected=PROTECTED_TEXT) -> DataFrame:
    """A10 statistics: for each unprotected text column, the non-null count,
    how many values are numeric, whether the column converts (>= threshold
    of its non-null values numeric) and how many values would become null.
    One aggregate over all columns, unpivoted with ``stack``."""
    cols = [f.name for f in df.schema.fields
            if f.dataType.typeName() == "string" and f.name not in protected]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, non_null bigint, numeric bigint, "
                                                   "converted boolean, lost bigint")
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__n"), F.count_if(F.col(c).rlike(_NUMERIC_TEXT)).alias(f"{c}__k")]
    row = df.agg(*aggs)
    stack = "stack({}, {}) as (column, non_null, numeric)".format(
        len(cols), ", ".join(f"'{c}', `{c}__n`, `{c}__k`" for c in cols))
    st = row.selectExpr(stack)
    conv = (F.col("numeric") >= F.lit(threshold) * F.col("non_null"))
    return st.select("column", F.col("non_null").cast("bigint"), F.col("numeric").cast("bigint"),
                     conv.alias("converted"),
                     F.when(conv, F.col("non_null") - F.col("numeric")).otherwise(F.lit(0)).cast("bigint").alias("lost"))


def apply_type_inference(df: DataFrame, threshold: float = 0.8, protected=PROTECTED_TEXT) -> DataFrame:
    """A10 applied: converts the qualifying text columns to double (one
    single-row decision action, then a plain projection)."""
    stats = type_inference_stats(df, threshold, protected).filter("converted").select("column").collect()
    conv = {r["column"] for r in stats}
    return df.select(*[F.when(F.col(c).rlike(_NUMERIC_TEXT), F.col(c).try_cast("double")).alias(c)
                       if c in conv else F.col(c) for c in df.columns])


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count and one non-empty sample value (the least as text)."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"{f.name}__n"),
                 F.min(F.when(c.cast("string") != "", c.cast("string"))).alias(f"{f.name}__s")]
    row = df.agg(*aggs)
    n = len(df.columns)
    stack = "stack({}, {}) as (column, dtype, non_null, sample)".format(
        n, ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', `{f.name}__n`, `{f.name}__s`"
                     for f in df.schema.fields))
    return row.selectExpr(stack)
