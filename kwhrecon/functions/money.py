"""Brazilian-format numbers.

Charged money is parsed to ``decimal(18,2)`` and measures to ``decimal(24,6)``:
sums are exact and independent of partitioning and input order; results are
cast to double at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from kwhrecon.functions.text import as_text, col_of, strip

MONEY = "decimal(18,2)"
# Numeric inputs (rates such as the tariff) keep six decimals when summed.
MEASURE = "decimal(24,6)"
# Blank text and dashes alone ("", "-", "--") are no numbers.
_PLAIN_NUMBER = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"


def _to_number(s: Column, kind: str) -> Column:
    return F.regexp_extract(s, _PLAIN_NUMBER, 0).try_cast(kind)


def _decimal_point(s: Column) -> Column:
    """``1.234,56`` -> ``1234.56``."""
    return F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def br_number(c, default=None, dtype=None, kind: str = MEASURE) -> Column:
    """``1.234,56`` -> 1234.56. Dots are thousands separators only when
    a comma is present; otherwise the text is read as a plain number.
    Null, blank tokens and unparsable text give ``default``.

    Measures (rates, energy, sums) keep six decimals; ``kind`` is the result's
    type. ``dtype``: the column's Spark type when known; numeric columns are cast.
    """
    c = col_of(c)
    dflt = F.lit(default).cast(kind)
    if dtype is not None and isinstance(dtype, NumericType):
        return F.coalesce(c.cast(MEASURE), dflt)
    s = strip(as_text(c))
    val = _to_number(F.when(s.contains(","), _decimal_point(s)).otherwise(s), kind)
    return val if default is None else F.coalesce(val, dflt)


def charge_money(c, strict_br: bool = False, dtype=None) -> Column:
    """charged value of the billing system.

    ``strict_br=True`` always drops dots before turning the comma into the
    decimal point (so ``1234.56`` reads as 123456, as the source system
    did); the default uses F8's comma test. Unparsable text -> null.
    """
    if dtype is not None and isinstance(dtype, NumericType):
        return col_of(c).cast(MONEY)
    if not strict_br:
        return br_number(c, kind=MONEY)
    s = strip(as_text(c))
    return _to_number(_decimal_point(s), MONEY)


def clamp_non_negative(c) -> Column:
    """negative rate -> 0 (nulls stay null)."""
    c = col_of(c)
    return F.when(c.isNotNull() & (c < 0), F.lit(0).cast("double")).otherwise(c.cast("double"))
