"""Display formats and output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwhrecon.functions.dates import parse_reference_period
from kwhrecon.functions.text import as_text, col_of, strip

# Portuguese month abbreviations, January first.
MONTH_ABBR = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]

# Accented Latin letters and their plain forms (search folding).
ACCENTED = "áàâãäåÁÀÂÃÄÅçÇéèêëÉÈÊËíìîïÍÌÎÏñÑóòôõöÓÒÔÕÖúùûüÚÙÛÜýÿÝ"
PLAIN = "aaaaaaAAAAAAcCeeeeEEEEiiiiIIIInNoooooOOOOOuuuuUUUUyyY"

DEFAULT_FILE_NAME = "arquivo"
DEFAULT_REPORT_NAME = "memoria_calculo"
_MONTHS_RE = "|".join(MONTH_ABBR)


def format_document(c) -> Column:
    """14 digits -> ``XX.XXX.XXX/XXXX-XX``; 11 -> ``XXX.XXX.XXX-XX``;
    shorter -> zero-padded to 14 and masked as the former; longer -> as is."""
    raw = F.regexp_replace(strip(c), r"[./-]", "")
    pad = F.lpad(raw, 14, "0")
    cnpj = F.regexp_replace(pad, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
    cnpj_any = F.concat(F.substring(pad, 1, 2), F.lit("."), F.substring(pad, 3, 3), F.lit("."),
                        F.substring(pad, 6, 3), F.lit("/"), F.substring(pad, 9, 4), F.lit("-"),
                        F.substring(pad, 13, 2))
    cpf = F.concat(F.substring(raw, 1, 3), F.lit("."), F.substring(raw, 4, 3), F.lit("."),
                   F.substring(raw, 7, 3), F.lit("-"), F.substring(raw, 10, 2))
    n = F.length(raw)
    return (F.when(col_of(c).isNull(), F.lit(None).cast("string"))
            .when(n == 11, cpf)
            .when(n <= 14, F.when(pad.rlike(r"^\d{14}$"), cnpj).otherwise(cnpj_any))
            .otherwise(as_text(c)))


def sanitize_filename(c, default: str = DEFAULT_FILE_NAME) -> Column:
    """characters outside ``[A-Za-z0-9_-]`` -> ``_``, runs collapsed,
    ``_`` trimmed at both ends; empty -> ``default``."""
    s = F.regexp_replace(F.regexp_replace(as_text(c), r"[^a-zA-Z0-9_\-]", "_"), "_+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def month_abbr(m: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_ABBR]), m)


def period_parts(c) -> Column:
    """``struct(year, month)`` of a billing month, null unless 1 <= month <= 12."""
    p = parse_reference_period(c)
    m = F.substring(p, 1, 2).try_cast("int")
    y = F.substring(p, 4, 4).try_cast("int")
    ok = p.rlike(r"^\d{2}-\d{4}$") & m.between(1, 12)
    return F.when(ok, F.struct(y.alias("year"), m.alias("month")))


def period_token(c) -> Column:
    """``jan_2026``; text that is no month -> sanitised lower-case text."""
    pp = period_parts(c)
    return F.when(pp.isNotNull(), F.concat(month_abbr(pp["month"]), F.lit("_"), pp["year"].cast("string"))) \
        .otherwise(sanitize_filename(F.lower(as_text(c)), DEFAULT_REPORT_NAME))


def periods_suffix(periods_array: Column) -> Column:
    """F26 over an ``array<string>``: distinct months sorted, grouped per year,
    e.g. ``jan_fev_2026`` or ``dez_2025_jan_2026``; no valid month -> ''.

    One fold over the sorted (year, month) parts, so the month parser
    appears once in the expression."""
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(periods_array, period_parts),
                                                    lambda x: x.isNotNull())))
    init = F.struct(F.lit(None).cast("int").alias("y"), F.lit("").alias("s"))

    def merge(acc, x):
        m = month_abbr(x["month"])
        return (F.when(acc["y"].isNull(), F.struct(x["year"].alias("y"), m.alias("s")))
                .when(acc["y"] == x["year"], F.struct(acc["y"].alias("y"), F.concat(acc["s"], F.lit("_"), m).alias("s")))
                .otherwise(F.struct(x["year"].alias("y"), F.concat(acc["s"], F.lit("_"), acc["y"].cast("string"),
                                                                   F.lit("_"), m).alias("s"))))

    def finish(acc):
        return F.when(acc["y"].isNull(), F.lit("")).otherwise(F.concat(acc["s"], F.lit("_"), acc["y"].cast("string")))

    return F.coalesce(F.aggregate(parts, init, merge, finish), F.lit(""))


def strip_period_signature(c) -> Column:
    """drop trailing ``_<month>[_<month>...]_<yyyy>`` runs from a sanitised name."""
    safe = sanitize_filename(c, DEFAULT_REPORT_NAME)
    stripped = F.regexp_replace(safe, rf"((?i)(_({_MONTHS_RE}))+_\d{{4}})+$", "")
    return F.when(F.regexp_replace(stripped, "^_+|_+$", "") == "", safe) \
        .otherwise(F.regexp_replace(stripped, "^_+|_+$", ""))


def is_generic_group_name(c) -> Column:
    return strip(c).rlike(r"^Grupo_\d+$")


def scope_base_name(name, clients: Column) -> Column:
    """F28 (base part) of a list of clients."""
    return scope_base_name_of(name, F.coalesce(F.size(clients), F.lit(0)), F.get(clients, F.lit(0)))


def scope_base_name_of(name, n: Column, first: Column) -> Column:
    """F28 (base part): custom name without its period signature; else the
    single client, ``<first>_e_outros``, or ``Memoria_Calculo``; sanitised."""
    name = col_of(name)
    custom = name.isNotNull() & (name != "") & ~as_text(name).startswith("Grupo_")
    base = (F.when(custom, strip_period_signature(name))
            .when(n == 1, first)
            .when(n > 1, F.concat(first, F.lit("_e_outros")))
            .otherwise(F.lit("Memoria_Calculo")))
    return sanitize_filename(base, DEFAULT_REPORT_NAME)


def output_file_name(name, clients: Column, periods: Column) -> Column:
    """F28 (one file per group) of a list of clients."""
    return output_file_name_of(name, F.coalesce(F.size(clients), F.lit(0)), F.get(clients, F.lit(0)), periods)


def output_file_name_of(name, n: Column, first: Column, periods: Column) -> Column:
    """F28 (one file per group): generic ``Grupo_<n>`` names take the client
    base plus the period suffix; any other name is kept, sanitised."""
    name = col_of(name)
    raw = F.coalesce(F.nullif(as_text(name), F.lit("")), F.lit("Sem_Nome"))
    base = sanitize_filename(F.when(n == 1, first)
                             .when(n > 1, F.concat(first, F.lit("_e_outros")))
                             .otherwise(raw))
    suffix = periods_suffix(periods)
    generic = F.when(suffix == "", F.concat(base, F.lit(".xlsx"))) \
        .otherwise(F.concat(base, F.lit("_"), suffix, F.lit(".xlsx")))
    return F.when(is_generic_group_name(raw), generic).otherwise(F.concat(sanitize_filename(raw), F.lit(".xlsx")))


def _count_and_first(clients: Column) -> tuple[Column, Column]:
    return F.coalesce(F.size(clients), F.lit(0)), F.get(clients, F.lit(0))


def suggested_name(name, clients: Column, periods: Column) -> Column:
    return suggested_name_of(name, *_count_and_first(clients), periods)


def suggested_name_of(name, n: Column, first: Column, periods: Column) -> Column:
    """F28 (suggested): the base name and the suffix of the months."""
    base, suffix = scope_base_name_of(name, n, first), periods_suffix(periods)
    return F.when(suffix == "", base).otherwise(F.concat(base, F.lit("_"), suffix))


def zip_entry_name(name, clients: Column, period) -> Column:
    return zip_entry_name_of(name, *_count_and_first(clients), period)


def zip_entry_name_of(name, n: Column, first: Column, period) -> Column:
    """F28 (entry of one month): the base name and the month's token."""
    return F.concat(scope_base_name_of(name, n, first), F.lit("_"), period_token(period), F.lit(".xlsx"))


def search_normalize(c) -> Column:
    """accents folded, lower case, non-alphanumerics -> single spaces, trimmed."""
    s = F.translate(as_text(c), ACCENTED, PLAIN)
    s = F.lower(F.regexp_replace(s, r"[^\x00-\x7F]", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]", " "), r"\s+", " ")
    return F.coalesce(F.regexp_replace(s, r"^ | $", ""), F.lit(""))


def sheet_title(c, default: str = "Consolidado") -> Column:
    """sheet name without ``\\ / ? * [ ] :``, at most 31 characters."""
    s = F.substring(F.regexp_replace(as_text(c), r"[\\/?*\[\]:]", ""), 1, 31)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def group_label(mode: str) -> Column:
    """label of a consolidated parent row."""
    return F.lit(f"Consolidado ({mode.capitalize()})")
