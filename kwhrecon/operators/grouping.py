"""Invoice grouping into parent / child / separator rows.

Plan: one ``groupBy`` over the group keys computes size, flags, the parsed
sums and the first appearance of the group (minimum report order); partial
aggregation makes a hot group cheap. Members are the original rows joined to
those facts; the rows of groups that may hold more than a bounded share of all
are dealt over salts (``operators.skew``), so that one group of a third of all
rows spreads over all tasks. The same join yields the parents: the member whose
order equals its group's minimum gives a second row with the sums put in, and
a third one, empty, that separates the group from the next. The rows to group
are thus read twice, besides their keys for the counts, and nothing is collected
per group. The order must be unique, as one that ends with the row ids is.
Layout order = (group first appearance, kind rank, row order), applied by
``layout_order`` with a range-partitioned sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.formats import group_label
from kwhrecon.functions.keys import group_key_text, strip_decimal_suffix
from kwhrecon.functions.money import br_number
from kwhrecon.functions.text import strip
from kwhrecon.operators.filters import is_main
from kwhrecon.operators.skew import hot_keys, salted_join

# Grouping flag, classification labels.
GROUP_FLAG_VALUE = "Agrupamento"
LABEL_INVOICE = "Fatura"
LABEL_RULE = "Regra de Negócio"
# Measures summed into a parent row (engine names).
SUM_COLUMNS = ["consumed_credit", "amount", "tariff", "cost_with_gd", "cost_without_gd", "savings"]
# Identifier columns cleaned (``.0`` suffix, blanks) once grouping keys exist.
ID_COLUMNS = ["uc", "alt_uc", "commercial_id", "account"]
MODES = ("default", "distributor", "cnpj", "none")


def classify(source: str = "source") -> Column:
    """Stripped source exactly ``Fatura`` -> ``Fatura``; else the rule label."""
    return F.when(F.coalesce(strip(source) == LABEL_INVOICE, F.lit(False)), F.lit(LABEL_INVOICE)) \
        .otherwise(F.lit(LABEL_RULE))


def _blank_null(c: str) -> Column:
    return F.when(strip(c) != "", F.col(c))


def has_commercial_ids(df: DataFrame, extra_keys=()) -> DataFrame | bool:
    """Whether any row carries a commercial id: per output (a small
    aggregate to join) when ``extra_keys`` are given, else one decision."""
    if "commercial_id" not in df.columns:
        return False
    flag = F.max(_blank_null("commercial_id").isNotNull()).alias("_has_ci")
    if extra_keys:
        return df.groupBy(*extra_keys).agg(flag)
    return df.filter(_blank_null("commercial_id").isNotNull()).limit(1).count() > 0


def group_keys(df: DataFrame, mode: str, has_ci) -> tuple[DataFrame, list[str]]:
    """A1: the group key columns of ``mode`` (null -> ``N/A``)."""
    cols = {"_g_period": group_key_text("period"), "_g_client": group_key_text("client")}
    if mode == "distributor":
        second = group_key_text("distributor") if "distributor" in df.columns else F.col("_g_client")
        return df.withColumns(cols).withColumn("_g_second", second), ["_g_period", "_g_second"]
    if mode == "cnpj":
        second = group_key_text("doc") if "doc" in df.columns else F.col("_g_client")
        return df.withColumns(cols).withColumn("_g_second", second), ["_g_period", "_g_second"]
    out = df.withColumns(cols)
    alt = _blank_null("alt_uc") if "alt_uc" in df.columns else None
    if isinstance(has_ci, Column) or has_ci is True:
        with_ci = F.coalesce(_blank_null("commercial_id"), *( [alt] if alt is not None else []), F.col("uc"))
        without = F.coalesce(alt, F.col("uc")) if alt is not None else F.col("uc")
        third = with_ci if has_ci is True else F.when(has_ci, with_ci).otherwise(without)
        if alt is not None and has_ci is not True:
            out = out.withColumn("alt_uc", F.when(has_ci, F.col("alt_uc")).otherwise(without))
    elif alt is not None:
        third = F.coalesce(alt, F.col("uc"))
        out = out.withColumn("alt_uc", third)
    else:
        flagged = F.coalesce(strip("group_flag") == GROUP_FLAG_VALUE, F.lit(False)) \
            if "group_flag" in df.columns else F.lit(False)
        third = F.when(flagged, F.lit("AGRUPADO")).otherwise(F.col("uc"))
    out = out.withColumn("_g_third", F.coalesce(third.cast("string"), F.lit("N/A")))
    return out, ["_g_period", "_g_client", "_g_third"]


def apply_grouping(df: DataFrame, mode: str = "default", include_child_rows: bool = True,
                   order: str = "ord", extra_keys=(), has_commercial=None) -> DataFrame:
    """A1-A4 + U2 + C1: rows of every group followed by a separator; a
    qualifying group (size > 1; in ``default`` mode also a grouping flag or
    a main marker) gets a parent row first -- the group's first row (in
    ``order``) labelled ``Consolidado (<Mode>)`` with the measures summed --
    and its rows become children (dropped when ``include_child_rows`` is
    false). Adds ``row_kind``, ``kind_rank``, ``group_ord``, ``classification``
    and the sum columns as doubles.
    """
    if mode not in MODES:
        raise ValueError(f"unknown grouping mode {mode!r}")
    if "period" not in df.columns or "client" not in df.columns:
        mode, include_child_rows = "none", True  # nothing to group by: the rows as they are
    extra_keys = list(extra_keys)
    sum_cols = [c for c in SUM_COLUMNS if c in df.columns]
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if mode == "none":
        out = df.filter(is_main()) if not include_child_rows and "main_flag" in df.columns else df
        out = out.withColumns({c: br_number(c, dtype=types[c]).cast("double") for c in sum_cols})
        return out.withColumns({"row_kind": F.lit("normal"), "kind_rank": F.lit(1),
                                "group_ord": F.col(order), "classification": classify()})
    has_ci = has_commercial
    if mode == "default" and has_ci is None:
        has_ci = has_commercial_ids(df, extra_keys)
    g = df
    if isinstance(has_ci, DataFrame):
        g = g.join(has_ci, extra_keys, "left")
        has_ci = F.coalesce(F.col("_has_ci"), F.lit(False))
    g, keys = group_keys(g, mode, has_ci)
    g = g.drop("_has_ci") if "_has_ci" in g.columns else g
    keys = extra_keys + keys
    g = g.withColumns({c: strip_decimal_suffix(c) for c in ID_COLUMNS if c in g.columns})
    flag = F.coalesce(strip("group_flag") == GROUP_FLAG_VALUE, F.lit(False)) \
        if "group_flag" in g.columns else F.lit(False)
    main = is_main() if "main_flag" in g.columns else F.lit(False)
    stats = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(flag | main).alias("_marked"),
        F.count_if(classify() == LABEL_INVOICE).alias("_n_invoice"),
        F.min(order).alias("group_ord"),
        *[F.sum(br_number(c, 0, dtype=types[c])).cast("double").alias("_sum_" + c) for c in sum_cols],
    )
    qualifies = (F.col("_n") > 1) & (F.col("_marked") if mode == "default" else F.lit(True))
    majority = F.when(F.col("_n_invoice") * 2 > F.col("_n"), F.lit(LABEL_INVOICE)).otherwise(F.lit(LABEL_RULE))
    stats = stats.withColumns({"_q": qualifies, "_majority": majority})
    sums = ["_sum_" + c for c in sum_cols]
    facts = stats.select(*keys, "_q", "group_ord", "_majority", *sums)
    joined = salted_join(g, facts, keys, hot_keys(g, keys), spread=[order])

    def kinds(*names) -> Column:
        rank = {"parent": 0, "child": 1, "normal": 1, "separator": 2}
        return F.array(*[F.struct(F.lit(k).alias("row_kind"), F.lit(rank[k]).alias("kind_rank")) for k in names])

    # a row of a group that qualifies gives a child, if wanted; the group's first row gives the parent and the separator besides
    first, child = F.col(order) == F.col("group_ord"), ["child"] if include_child_rows else []
    made = (F.when(first & F.col("_q"), kinds("parent", *child, "separator")).when(first, kinds("normal", "separator"))
            .when(~F.col("_q"), kinds("normal")).otherwise(kinds(*child) if child else F.slice(kinds("normal"), 1, 0)))
    # a column of its own: what stands inside a generator is interpreted where its stage is too large to compile
    rows = joined.withColumn("_kinds", made).withColumn("_made", F.explode("_kinds")).drop("_kinds")
    kind, columns = F.col("_made.row_kind"), [c for c in g.columns if c not in keys]
    parent, written = kind == "parent", kind != "separator"
    values = {c: F.col(c) for c in columns} | {c: br_number(c, dtype=types[c]).cast("double") for c in sum_cols}
    values |= {c: F.when(parent, F.col("_sum_" + c)).otherwise(values[c]) for c in sum_cols}
    values["uc"] = F.when(parent, group_label(mode)).otherwise(F.col("uc"))
    label = F.when(parent, F.col("_majority")).otherwise(classify()) if include_child_rows else classify()
    return rows.select(*keys, *[F.when(written, v).alias(c) for c, v in values.items()], "group_ord", kind.alias("row_kind"),
                       F.col("_made.kind_rank").alias("kind_rank"), F.when(written, label).otherwise(LABEL_RULE).alias("classification"))


def layout_order(extra_keys=()) -> list[Column]:
    """O6 (+ output keys first): groups by first appearance, then parent,
    rows, separator; rows in report order."""
    return [F.col(k) for k in extra_keys] + [F.col("group_ord").asc_nulls_last(), F.col("kind_rank"),
                                            F.col("ord").asc_nulls_last()]
