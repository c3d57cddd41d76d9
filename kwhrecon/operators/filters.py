"""Scope and row predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.dates import normalize_period_value, period_month
from kwhrecon.functions.formats import search_normalize
from kwhrecon.functions.keys import doc_digits
from kwhrecon.functions.text import as_text, col_of, is_blank, lower_strip, strip

INCOMPLETE_TOKENS = ["", "nan", "nat", "none"]


def client_scope(df: DataFrame, clients, client: str = "client", doc: str = "doc") -> DataFrame:
    """P1 + P2 (J8): rows of the given clients plus every row sharing a
    (digit-normalised, non-empty) document with them. Empty list = all rows.

    The document set is a join, not a collected list: its size follows the
    data. AQE broadcasts it only when its measured size is small.
    """
    if not clients:
        return df
    picked = F.col(client).isin(list(clients))
    if doc not in df.columns:
        return df.filter(picked)
    # the clients' own rows need no join; of the rest only the membership of the
    # document is tested, against distinct documents
    chosen = F.coalesce(picked, F.lit(False))
    keyed = df.withColumn("_doc_key", doc_digits(doc))
    docs = keyed.filter(chosen & (F.col("_doc_key") != "")).select("_doc_key").distinct()
    rest = keyed.filter(~chosen & (F.col("_doc_key") != "")).join(docs, "_doc_key", "left_semi")
    return keyed.filter(chosen).unionByName(rest).drop("_doc_key")


def period_scope(df: DataFrame, periods, period: str = "period") -> DataFrame:
    """Month in the list after normalising both sides (F5). Empty list =
    all rows; a list with no valid month keeps no row."""
    if not periods:
        return df
    wanted = [normalize_period_value(F.lit(p)) for p in periods]
    norm = normalize_period_value(period)
    out = df.filter((norm != "") & norm.isin(*wanted))
    if "period_month" in df.columns:
        # superset on the partition column (constant-folded): the requested
        # valid months, or null for rows whose month text is not a valid
        # month -- lets a month-partitioned table skip the other partitions
        months = [period_month(F.lit(p)) for p in periods]
        out = out.filter(F.col("period_month").isNull() | F.col("period_month").isin(*months))
    return out


def filter_scope(df: DataFrame, clients, periods, client: str = "client",
                 doc: str = "doc", period: str = "period") -> DataFrame:
    return period_scope(client_scope(df, clients, client, doc), periods, period)


def incomplete(due: str = "due_date") -> Column:
    """Due date missing (null or an empty-like token)."""
    return F.col(due).isNull() | lower_strip(due).isin(INCOMPLETE_TOKENS)


def completeness_filter(df: DataFrame, mode: str = "all", due: str = "due_date") -> DataFrame:
    """P5: ``all`` / ``complete_only`` / ``incomplete_only``."""
    if mode == "all":
        return df
    if due not in df.columns:  # nothing can be incomplete
        return df if mode == "complete_only" else df.filter(F.lit(False))
    return df.filter(~incomplete(due)) if mode == "complete_only" else df.filter(incomplete(due))


def positive_charge(col: str = "charged_amount") -> Column:
    """Charged value present, a number and > 0 (text that is none and NaN are not)."""
    value = F.col(col).try_cast("double")
    return F.coalesce(~F.isnan(value) & (value > 0), F.lit(False))


def not_paid(status: str = "status") -> Column:
    """Final status is not ``pago``."""
    return F.coalesce(lower_strip(status) != "pago", F.lit(True))


def is_main(main: str = "main_flag") -> Column:
    """P10: hierarchy parent marker ``Y``."""
    return F.coalesce(F.upper(strip(main)) == "Y", F.lit(False))


def search_filter(df: DataFrame, col: str, term: str | None) -> DataFrame:
    """accent/case-insensitive contains; empty term = all rows."""
    if not term:
        return df
    return df.filter(search_normalize(col).contains(search_normalize(F.lit(term))))


def contains_ci(col: str, term: str) -> Column:
    """Case-insensitive plain contains (null -> false)."""
    return F.coalesce(F.lower(as_text(col)).contains(term.lower()), F.lit(False))


def filled(col) -> Column:
    """Not null and not the empty string."""
    c = col_of(col)
    return c.isNotNull() & (as_text(c) != "")


def exclude_kinds(df: DataFrame, kinds=("parent", "separator"), kind: str = "row_kind") -> DataFrame:
    """Drop parent and separator rows."""
    return df.filter(~F.col(kind).isin(list(kinds)))


__all__ = ["client_scope", "period_scope", "filter_scope", "incomplete", "completeness_filter",
           "positive_charge", "not_paid", "is_main", "search_filter", "contains_ci", "filled",
           "exclude_kinds", "is_blank"]
