"""Date and billing-month parsing.

All parsing is regex extraction plus ``try_cast(... AS DATE)``, so an
impossible date (``31/02/2026``) is null instead of an error and the same
rules can be written in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwhrecon.functions.text import as_text, strip

NOT_AVAILABLE = "Não disponível"

# Rewrites applied in order; each turns one accepted layout into the
# canonical ``yyyy-M-d`` text. A middle part of 13 or more cannot be a month,
# so those day-first layouts are read month-first. Two-digit years: 00-68 ->
# 20yy, 69-99 -> 19yy. Month-year and compact layouts must be the whole text;
# the others may carry a time part after a space or a "T".
_SEP = r"[-/.]"
_NOT_MONTH = r"(1[3-9]|[2-9]\d)"
_YY20 = r"([0-5]\d|6[0-8])"
_YY19 = r"(69|[7-9]\d)"
_DATE_REWRITES = [
    (rf"^(\d{{4}}){_SEP}(\d{{1,2}})$", "$1-$2-1"),
    (rf"^(\d{{1,2}}){_SEP}(\d{{4}})$", "$2-$1-1"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^([0-9./-]+)[ T].*$", "$1"),
    (rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})$", "$1-$2-$3"),
    (rf"^(\d{{1,2}}){_SEP}{_NOT_MONTH}{_SEP}(\d{{4}})$", "$3-$1-$2"),
    (rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}})$", "$3-$2-$1"),
    (rf"^(\d{{1,2}}){_SEP}{_NOT_MONTH}{_SEP}{_YY20}$", "20$3-$1-$2"),
    (rf"^(\d{{1,2}}){_SEP}{_NOT_MONTH}{_SEP}{_YY19}$", "19$3-$1-$2"),
    (rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}{_YY20}$", "20$3-$2-$1"),
    (rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}{_YY19}$", "19$3-$2-$1"),
]
_CANONICAL = r"^(\d{4}-\d{1,2}-\d{1,2})$"
# An optional day, an English month name or its first letters, and a year.
_NAMED = r"^(?:(\d{1,2})[-/. ]+)?([A-Za-z]{3})[A-Za-z]*[-/., ]+(\d{4})$"
# First letters of the English month names, in order.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _g(s: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(s, pattern, i)


def _named_date(s: Column) -> Column:
    """``10 Feb 2026`` or ``Jan-2026`` (first of the month); null for other words."""
    at = F.instr(F.lit(_MONTHS), F.lower(_g(s, _NAMED, 2)))
    day = F.coalesce(F.nullif(_g(s, _NAMED, 1), F.lit("")), F.lit("1"))
    return F.when(at % 3 == 1, F.concat_ws("-", F.right(s, F.lit(4)), F.floor((at + 2) / 3).cast("string"), day)).try_cast("date")


def parse_full_date(c) -> Column:
    """full date from mixed text; ``DateType`` or null.

    Accepted: year-first ``yyyy-M-d`` (separators ``-/.``), day-first
    ``d/M/yyyy`` (month-first when the middle part is 13 or more), the same
    with two-digit years, ``M/yyyy`` and ``yyyy/M`` (first of the month),
    ``yyyyMMdd``, and English month names (``10 Feb 2026``, ``Jan-2026``).
    Null tokens, junk and impossible dates give null. One linear chain of
    rewrites and a single ``try_cast`` keep the generated code small.
    """
    s = strip(c)
    chain = s
    for pattern, repl in _DATE_REWRITES:
        chain = F.regexp_replace(chain, pattern, repl)
    first = F.substring(s, 1, 1)
    day_first = lambda a, b: F.concat(F.substring(s, 7, 4), F.lit("-"), F.substring(s, a, 2),
                                      F.lit("-"), F.substring(s, b, 2)).try_cast("date")
    # the common layouts have parts at fixed places and need one pattern test; without month names
    # nothing that starts without a digit is a date; the rewrite chain handles the rest
    return (F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
            .when(s.rlike(rf"^\d{{2}}{_SEP}\d{{2}}{_SEP}\d{{4}}$"), F.coalesce(day_first(4, 1), day_first(1, 4)))
            .when(s.rlike(_NAMED), _named_date(s))
            .when(~first.between("0", "9") | first.isNull(), F.lit(None).cast("date"))
            .otherwise(F.regexp_extract(chain, _CANONICAL, 1).try_cast("date")))


# Layouts whose month and year stand at fixed places; a date that starts with
# its year counts by that prefix, whatever follows the day.
_MONTH_YEAR = r"^\d{2}[-/]\d{4}$"
_YEAR_MONTH = r"^\d{4}-\d{2}(-\d{1,2}.*)?$"
_YEAR_SHORT_MONTH = r"^\d{4}-\d-\d{1,2}.*$"


def _month_text(c, month_year, year_month, short_month, other) -> Column:
    """The value built for the layout of ``c``; each builder takes the stripped text."""
    s = strip(c)
    return (F.when(s.rlike(_MONTH_YEAR), month_year(s))
            .when(s.rlike(_YEAR_MONTH), year_month(s))
            .when(s.rlike(_YEAR_SHORT_MONTH), short_month(s))
            .otherwise(other))


def parse_reference_period(c) -> Column:
    """billing month as text ``MM-YYYY`` (the month is not validated).

    ``YYYY-MM``, ``MM-YYYY``, ``MM/YYYY`` and a year-first date prefix are
    read directly; anything else goes through F1.
    """
    part = F.substring
    return _month_text(
        c,
        lambda s: F.translate(s, "/", "-"),
        lambda s: F.concat(part(s, 6, 2), F.lit("-"), part(s, 1, 4)),
        lambda s: F.concat(F.lit("0"), part(s, 6, 1), F.lit("-"), part(s, 1, 4)),
        F.date_format(parse_full_date(c), "MM-yyyy"))


def format_full_date(c, default: str = NOT_AVAILABLE) -> Column:
    """``dd-MM-yyyy`` or ``default``."""
    return F.coalesce(F.date_format(parse_full_date(c), "dd-MM-yyyy"), F.lit(default))


def format_reference_period(c, default: str | None = NOT_AVAILABLE) -> Column:
    """``MM/yyyy`` or ``default``."""
    return F.coalesce(F.regexp_replace(parse_reference_period(c), "-", "/"),
                      F.lit(default).cast("string"))


def normalize_period_value(c) -> Column:
    """``MM/yyyy``; anything invalid becomes the empty string."""
    return format_reference_period(c, "")


def period_month(c) -> Column:
    """first day of the billing month as ``DateType`` (join/partition key).

    Deliberate difference: an out-of-range month (``13-2025``) gives null,
    an unmatched key, instead of aborting the whole run.
    """
    part = F.substring
    return _month_text(
        c,
        lambda s: F.concat(part(s, 4, 4), F.lit("-"), part(s, 1, 2), F.lit("-01")).try_cast("date"),
        lambda s: F.concat(part(s, 1, 7), F.lit("-01")).try_cast("date"),
        lambda s: F.concat(part(s, 1, 5), F.lit("0"), part(s, 6, 1), F.lit("-01")).try_cast("date"),
        F.trunc(parse_full_date(c), "MM"))


def period_sort_key(c) -> Column:
    """``struct(year, month, text)``; invalid months sort last as (9999, 99)."""
    t = as_text(c)
    norm = F.regexp_replace(strip(t), "-", "/")
    pat = r"^(\d+)/(\d+)$"
    m = _g(norm, pat, 1).try_cast("int")
    y = _g(norm, pat, 2).try_cast("int")
    ok = norm.rlike(pat) & m.between(1, 12) & y.isNotNull()
    return F.struct(
        F.when(ok, y).otherwise(F.lit(9999)).alias("year"),
        F.when(ok, m).otherwise(F.lit(99)).alias("month"),
        t.alias("text"),
    )
