"""Calculation reports over the consolidated table.

``generate`` is one lazy plan: scope (P1-P3) -> portal restriction (J6,
P7, D9, D4, V5) -> enrichment (J7) -> completeness (P5) -> report order
(O3) -> grouping (A1-A4, U2, C1) -> projection (V1) -> payment rules
(C2-C4) -> hide paid (P9) -> writer values and sheets (F19, F20, K5).
``generate_many`` (T3) and ``generate_by_month`` (T4) run the same plan
once for all outputs, with the output name or month as an extra key of
every keyed step -- one job, not a loop over groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.dates import normalize_period_value
from kwhrecon.functions.formats import output_file_name_of
from kwhrecon.functions.keys import doc_digits
from kwhrecon.functions.money import br_number
from kwhrecon.operators import enrich as E
from kwhrecon.operators import filters as P
from kwhrecon.operators import grouping as G
from kwhrecon.operators import layout as L
from kwhrecon.operators import payment as C
from kwhrecon.operators import portal as J
from kwhrecon.operators.late import ROW
from kwhrecon.session import materialize

SORT_SAVINGS = "Economia Gerada (Desc)"
SORT_CLIENT = "Razão Social"
SORT_UNIT = "Instalação (UC)"


@dataclass
class ReportOptions:
    incomplete_filter: str = "all"
    grouping_mode: str = "default"
    group_by_distributor: bool = False
    include_child_rows: bool = True
    only_pending: bool = False
    presentation: str = L.SINGLE_TABLE
    split_audit: bool = False
    sort_by: str = SORT_SAVINGS
    as_of: object = None
    # materialise the restricted, enriched scope in the shared checkpoint
    # folder: grouping reads it twice (facts, members)
    checkpoint: bool = True
    extra: dict = field(default_factory=dict)

    def mode(self) -> str:
        if self.grouping_mode == "default" and self.group_by_distributor:
            return "distributor"
        return self.grouping_mode


def report_order(df: DataFrame, sort_by: str) -> Column:
    """O3: the report order as one ascending struct: the chosen key (savings
    descending, client or unit ascending with nulls last; unknown option =
    none), then the D4 preference order (which ends with the row order)."""
    if sort_by == SORT_SAVINGS and "savings" in df.columns:
        key = [(-br_number("savings", 0, dtype=df.schema["savings"].dataType)).alias("_k")]
    elif sort_by == SORT_CLIENT and "client" in df.columns:
        key = [F.col("client").isNull().alias("_kn"), F.col("client").alias("_k")]
    elif sort_by == SORT_UNIT and "uc" in df.columns:
        key = [F.col("uc").isNull().alias("_kn"), F.col("uc").cast("string").alias("_k")]
    else:
        key = []
    tail = [F.col("pref_ord")] if "pref_ord" in df.columns else [F.col("src"), F.col("row_id")]
    return F.struct(*key, *[t.alias(f"_t{i}") for i, t in enumerate(tail)])


def _finish(work: DataFrame, opts: ReportOptions, extra_cols, extra_keys) -> DataFrame:
    work = P.completeness_filter(work, opts.incomplete_filter)
    if opts.checkpoint:
        work = materialize(work)
    work = work.withColumn("ord", report_order(work, opts.sort_by))
    grouped = G.apply_grouping(work, opts.mode(), opts.include_child_rows, extra_keys=extra_keys)
    proj = L.report_projection(grouped, extra_cols, keep=list(extra_keys))
    paid = C.payment_rules(proj, opts.as_of)
    if opts.only_pending:
        paid = paid.filter(P.not_paid())
    out = L.output_values(paid)
    return L.blank_separators(L.assign_sheets(out, opts.presentation, opts.split_audit))


def _with_metadata(won: DataFrame, metadata: DataFrame | None, taken) -> tuple[DataFrame, list[str]]:
    """J7 on the narrow winners of the portal restriction: their rows, fetched afterwards, bring the columns ``taken``."""
    if metadata is None:
        return won, []
    own = metadata.drop(*[c for c in metadata.columns if c in taken and c not in ("uc", "seq")])
    rows, extra = E.enrich_left(won.withColumnRenamed("uc_final", "uc"), own, reserved=L.REPORT_NAMES)
    return rows.withColumnRenamed("uc", "uc_final"), extra


def _enriched(scope: DataFrame, alias_scope: DataFrame, metadata: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """The portal restriction of a scope with its metadata columns, and their names."""
    if "charged_amount" not in scope.columns:
        return E.enrich_left(scope, metadata, reserved=L.REPORT_NAMES) if metadata is not None else (scope, [])
    names: list[str] = []

    def enrich(won: DataFrame) -> DataFrame:
        rows, extra = _with_metadata(won, metadata, scope.columns)
        names.extend(extra)
        return rows

    return J.restrict_to_portal(scope, alias_scope, enrich=enrich), names


def generate(consolidated: DataFrame, clients, periods, metadata: DataFrame | None = None,
             opts: ReportOptions | None = None) -> DataFrame:
    """The report rows of one scope (unsorted; see ``sorted_report``)."""
    opts = opts or ReportOptions()
    scope = P.filter_scope(consolidated, clients, periods)
    alias_scope = P.filter_scope(consolidated, clients, [])
    work, extra_cols = _enriched(scope, alias_scope, metadata)
    return _finish(work, opts, extra_cols, [])


def generate_by_month(consolidated: DataFrame, clients, periods, metadata: DataFrame | None = None,
                      opts: ReportOptions | None = None) -> DataFrame:
    """T4: one output per month (``output_period``), as one plan."""
    opts = opts or ReportOptions()
    scope = P.filter_scope(consolidated, clients, periods)
    alias_scope = P.filter_scope(consolidated, clients, [])
    work, extra_cols = _enriched(scope, alias_scope, metadata)
    return _finish(work.withColumn("output_period", normalize_period_value("period")), opts, extra_cols, ["output_period"])


GROUP_KEYS = ["group_id", "output_name"]


def group_names(groups: DataFrame, periods: DataFrame) -> DataFrame:
    """(group_id, group_name, n_clients, first_client, periods, output_name) of the
    groups that have clients and months. ``groups`` has one row per client and
    ``periods`` one per month; a name needs only the number of different clients,
    the first of them and the months (a list bounded by the calendar)."""
    heads = groups.filter(F.col("client").isNotNull()).groupBy("group_id").agg(
        F.min("group_name").alias("group_name"), F.count_distinct("client").alias("n_clients"), F.min("client").alias("first_client"))
    months = periods.groupBy("group_id").agg(F.sort_array(F.collect_set("period")).alias("periods"))
    return heads.join(months, "group_id").withColumn(
        "output_name", output_file_name_of("group_name", F.col("n_clients"), F.col("first_client"), F.col("periods")))


def group_membership(consolidated: DataFrame, groups: DataFrame) -> DataFrame:
    """J10 + J11 + P1/P2 for many groups at once: the rows of any group, each once, with ``groups``, the set of its group ids.

    A row belongs to a group when its client is listed or its (non-empty)
    document is one of the listed clients' documents: rows with a document match
    through the document only, rows without one through the client. The sets per
    document and per client are stored, so both joins are plain shuffles.
    """
    members = E.group_clients(groups).select("group_id", "client")
    keyed = consolidated.withColumn("_doc_key", doc_digits("doc"))
    pairs = keyed.filter(F.col("_doc_key") != "").select("client", "_doc_key").distinct()
    by_doc = materialize(pairs.join(members, "client").groupBy(F.col("_doc_key").alias("_probe_doc")).agg(F.collect_set("group_id").alias("_g_doc")))
    by_client = materialize(members.groupBy(F.col("client").alias("_probe_client")).agg(F.collect_set("group_id").alias("_g_client")))
    # rows that can match on one side only get a key of their own for the other
    own = F.concat(F.lit("#"), F.col("src").cast("string"), F.lit(":"), F.col("row_id").cast("string"))
    rows = keyed.withColumns({
        "_probe_doc": F.when(F.col("_doc_key") != "", F.col("_doc_key")).otherwise(own),
        "_probe_client": F.when((F.col("_doc_key") == "") & F.col("client").isNotNull(), F.col("client")).otherwise(F.concat(F.lit("\u0001"), own))})
    rows = rows.join(by_doc, "_probe_doc", "left").join(by_client, "_probe_client", "left")
    return (rows.withColumn("groups", F.coalesce("_g_doc", "_g_client")).filter(F.col("groups").isNotNull())
            .drop("_doc_key", "_probe_doc", "_probe_client", "_g_doc", "_g_client"))


def _group_months(periods: DataFrame) -> DataFrame:
    return (periods.select("group_id", normalize_period_value("period").alias("_month"))
            .filter(F.col("_month") != "").distinct().withColumn("in_months", F.lit(True)))


def group_scope(consolidated: DataFrame, groups: DataFrame, periods: DataFrame) -> DataFrame:
    """The rows of ``group_membership`` once per group, with ``GROUP_KEYS`` and ``in_months`` (P3). The group id
    keeps outputs apart whose names (F28) are equal; a client listed twice counts once. Groups without clients or
    months produce nothing (K3)."""
    # stored, so that its size is known: one row per saved group does not have the scope shuffled by group
    names = materialize(group_names(groups, periods).select(*GROUP_KEYS))
    scope = group_membership(consolidated, groups).withColumn("group_id", F.explode("groups")).drop("groups")
    scope = scope.join(names, "group_id")
    scope = scope.withColumn("_month", normalize_period_value("period"))
    return (scope.join(_group_months(periods), ["group_id", "_month"], "left")
            .withColumn("in_months", F.coalesce("in_months", F.lit(False))).drop("_month"))


def generate_many(consolidated: DataFrame, groups: DataFrame, periods: DataFrame, metadata: DataFrame | None = None,
                  opts: ReportOptions | None = None) -> DataFrame:
    """One output per saved group (``GROUP_KEYS``), as one plan over one scope.

    Rows carry the set of their groups; only the few columns that decide the
    portal restriction are repeated per group, and whole rows are fetched for the
    winners. The stored scope has one narrow row per table row.
    """
    opts = opts or ReportOptions()
    names = materialize(group_names(groups, periods).select(*GROUP_KEYS))
    ids = [ROW] if ROW in consolidated.columns else J.ORDER
    deciding = [c for c in dict.fromkeys([*ids, *J.ORDER, "uc", "portal_uc", "alt_uc", "period", "source", "account", "amount", "charged_amount"])
                if c in consolidated.columns]
    scope = group_membership(consolidated, groups).withColumn("_month", normalize_period_value("period"))
    scope = scope.select(*deciding, "_month", "groups")
    scope = (materialize(scope) if opts.checkpoint else scope).withColumn("group_id", F.explode("groups")).drop("groups")
    aliases = J.alias_map(scope, extra_keys=["group_id"])
    wanted = _group_months(periods).join(names.select("group_id"), "group_id", "left_semi").drop("in_months")
    due = scope.filter(P.positive_charge()).join(wanted, ["group_id", "_month"], "left_semi").drop("_month")
    won = J.portal_winners(due, aliases, extra_keys=["group_id"]).join(names, "group_id")
    won, extra_cols = _with_metadata(won, metadata, [*consolidated.columns, *GROUP_KEYS])
    return _finish(J.billed(consolidated.join(won, ids)), opts, extra_cols, GROUP_KEYS)


def sorted_report(report: DataFrame, extra_keys=()) -> DataFrame:
    """Rows in layout order (range-partitioned global sort)."""
    return report.orderBy(*G.layout_order(extra_keys))


def flat_report(report: DataFrame) -> DataFrame:
    """The report without struct helper columns (for writing as CSV/JSON)."""
    return report.drop("ord", "group_ord")
