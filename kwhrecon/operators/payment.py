"""Payment status and output formats of dates."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.dates import NOT_AVAILABLE, format_reference_period, parse_full_date
from kwhrecon.functions.text import lower_strip

# The four payment states and the text that means "no payment date".
PAID, LATE, OPEN, NEGOTIATED = "Pago", "Atrasado", "Em aberto", "Negociado"
STATES = [PAID, LATE, OPEN, NEGOTIATED]
NO_PAYMENT_TOKENS = ["", "-", "n/a", "não", "none", "nan", "nat"]


def _as_date(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.isoformat()[:10]
    return F.lit(str(as_of)).cast("date")


def payment_rules(df: DataFrame, as_of=None, status: str = "status", due: str = "due_date",
                  paid: str = "paid_date", period: str = "period") -> DataFrame:
    """Month as ``MM/yyyy`` (invalid -> ``Não disponível``, null stays
    null); due date as ``dd-MM-yyyy`` or ``Não disponível``; status by
    precedence Negociado > Pago > Atrasado > Em aberto, where "paid" is a
    status containing ``pago`` or a valid payment date, and "late" a due
    date before ``as_of`` (today when not given); the payment date is kept
    (``dd-MM-yyyy``, or '' when paid without one) only for paid rows."""
    s = F.coalesce(lower_strip(status), F.lit("")) if status in df.columns else F.lit("")
    # parse the due date once; status and output text both read the column
    df = df.withColumn("_due_d", parse_full_date(due) if due in df.columns else F.lit(None).cast("date"))
    due_d = F.col("_due_d")
    if paid in df.columns:
        paid_d = F.when(~F.coalesce(lower_strip(paid).isin(NO_PAYMENT_TOKENS), F.lit(False)),
                        parse_full_date(paid))
    else:
        paid_d = F.lit(None).cast("date")
    negotiated = s.contains("negociad") | s.contains("acordo")
    is_paid = s.contains("pago") | paid_d.isNotNull()
    new_status = (F.when(negotiated, F.lit(NEGOTIATED)).when(is_paid, F.lit(PAID))
                  .when(due_d < _as_date(as_of), F.lit(LATE)).otherwise(F.lit(OPEN)))
    new_paid = F.when(~negotiated & is_paid, F.coalesce(F.date_format(paid_d, "dd-MM-yyyy"), F.lit("")))
    cols = {status: new_status, paid: new_paid,
            due: F.coalesce(F.date_format(due_d, "dd-MM-yyyy"), F.lit(NOT_AVAILABLE))}
    if period in df.columns:
        cols[period] = F.when(F.col(period).isNull(), F.lit(None).cast("string")) \
            .otherwise(format_reference_period(period))
    return df.withColumns(cols).drop("_due_d")


def payment_violations(df: DataFrame, status: str = "status", due: str = "due_date") -> DataFrame:
    """A16 as one row of counts (all zero on valid output)."""
    return df.agg(F.count_if(F.col(due).isNull()).alias("null_due"),
                  F.count_if(F.col(status).isNull()).alias("null_status"),
                  F.count_if(~F.col(status).isin(STATES)).alias("bad_status"))


def check_payment_rules(df: DataFrame, **kw) -> None:
    """Raise when any output row breaks the rules (one aggregate row)."""
    row = payment_violations(df, **kw).first()
    if any(row):
        raise ValueError(f"payment rules violated: {row.asDict()}")
