"""Unit, document and identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwhrecon.functions.text import as_text, col_of, strip


def _null_str() -> Column:
    return F.lit(None).cast("string")


def _drop_dot_zero(s: Column) -> Column:
    """One trailing ``.0`` removed (plain string ops, no regex)."""
    return F.when(s.endswith(".0"), F.left(s, F.length(s) - 2)).otherwise(s)


def _no_text(c, s: Column) -> Column:
    """Null, blank, ``nan`` or ``none``; lower-casing never shortens, so only short text (``s``, stripped) is lower-cased."""
    return col_of(c).isNull() | ((F.length(s) <= 4) & F.lower(s).isin("", "nan", "none"))


def uc_key(c) -> Column:
    """join key of a unit: strip, one trailing ``.0`` off, digits only,
    no leading zeros. Null becomes the empty string (which is a value)."""
    s = _drop_dot_zero(strip(c))
    return F.coalesce(F.ltrim(F.regexp_replace(s, r"[^0-9]", ""), F.lit("0")), F.lit(""))


def portal_uc(c) -> Column:
    """unit id as the charge system shows it; blank/``nan``/``none`` -> null."""
    s = _drop_dot_zero(strip(c))
    return F.when(_no_text(c, s), _null_str()).otherwise(s)


def uc_text(c) -> Column:
    """unit text for dedupe keys; the token test runs before the ``.0`` strip."""
    s = strip(c)
    return F.when(_no_text(c, s), _null_str()).otherwise(_drop_dot_zero(s))


def doc_digits(c) -> Column:
    """digits of a tax document; null -> empty string."""
    return F.coalesce(F.regexp_replace(as_text(c), r"[^0-9]", ""), F.lit(""))


def identity_key(c) -> Column:
    """letters and digits only, upper-cased, leading zeros kept; null -> ''."""
    s = _drop_dot_zero(strip(c))
    return F.coalesce(F.upper(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")), F.lit(""))


def contains_letter(c) -> Column:
    """F16: true when the text has at least one letter (null -> false)."""
    return F.coalesce(as_text(c).rlike(r"\p{L}"), F.lit(False))


def account_text(c) -> Column:
    """account number text; ``123.0`` -> ``123`` through a numeric cast
    (leading zeros go), other text as is, null stays null.

    Deliberate difference: non-numeric text ending in ``.0`` keeps its text
    minus the suffix instead of raising.
    """
    t = as_text(c)
    as_int = t.try_cast("decimal(38,1)").cast("decimal(38,0)").cast("string")
    return F.when(t.isNull(), _null_str()).when(t.endswith(".0"), F.coalesce(as_int, _drop_dot_zero(t))).otherwise(t)


def strip_decimal_suffix(c, tokens=("nan", "None", "")) -> Column:
    """text with a trailing ``.0`` removed, stripped; the tokens become null."""
    s = strip(_drop_dot_zero(as_text(c)))
    return F.when(col_of(c).isNull() | s.isin(list(tokens)), _null_str()).otherwise(s)


def group_key_text(c, fill: str | None = "N/A") -> Column:
    """grouping text: stripped, upper-cased; blank/``NAN``/``NONE`` -> ``fill``."""
    s = F.upper(strip(c))
    v = F.when(col_of(c).isNull() | s.isin("NAN", "NONE", ""), _null_str()).otherwise(s)
    return F.coalesce(v, F.lit(fill)) if fill is not None else v
