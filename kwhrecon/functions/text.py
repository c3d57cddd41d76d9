"""Small text helpers shared by the column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """Any value as text (numbers through their string form)."""
    return col_of(c).cast("string")


# Characters removed at both ends of text by ``strip``.
WHITESPACE = " \t\n\r\f\u000b\u00a0"


def strip(c) -> Column:
    """Remove leading/trailing whitespace (tabs, newlines, no-break space too)."""
    return F.btrim(as_text(c), F.lit(WHITESPACE))


def lower_strip(c) -> Column:
    return F.lower(strip(c))


def is_blank(c) -> Column:
    """Null or only whitespace."""
    return col_of(c).isNull() | (strip(c) == F.lit(""))
