"""Registered queries: scope, portal restriction, grouping and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kwhrecon.functions import formats as FM
from kwhrecon.operators import enrich as E
from kwhrecon.operators import filters as P
from kwhrecon.operators import portal as J
from kwhrecon.operators import summary as S
from kwhrecon.operators import layout as L
from kwhrecon.plans import oracle as O
from kwhrecon.plans import report as RP
from kwhrecon.plans import tables as T
from kwhrecon.sources.fixtures import GROUP_PERIODS

Q: dict = {}
AS_OF = "1996-06-01"


def register(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


W = O.duckdb_ctes()
W1 = O.t1_ctes()


def _opts(**kw):
    return RP.ReportOptions(as_of=AS_OF, **kw)


def _report(spark, sf, **kw):
    meta = T.metadata(spark, sf)
    return RP.flat_report(RP.generate(T.consolidated(spark, sf), [], [], meta, _opts(**kw)))


def _sql(tail="SELECT * FROM report", **kw):
    return O.report_ctes(as_of=AS_OF, **kw) + "\n" + tail


# ------------------------------------------------------------------ scope

@register("filter_clients_docs", f"""{W1},
{O.group_scope_ctes()}
SELECT group_id, output_name, src, row_id FROM scope_all""")
def filter_clients_docs(spark, sf):
    s = RP.group_scope(T.consolidated(spark, sf), T.groups(spark, sf), T.group_periods(spark, sf))
    return s.select("group_id", "output_name", "src", "row_id")


@register("group_scope", f"""{W1},
{O.group_scope_ctes()}
SELECT group_id, output_name, src, row_id, period FROM scope_p""")
def group_scope(spark, sf):
    s = RP.group_scope(T.consolidated(spark, sf), T.groups(spark, sf), T.group_periods(spark, sf))
    return s.filter("in_months").select("group_id", "output_name", "src", "row_id", "period")


# a scope of named clients and months, as a user picks them
SCOPE_CLIENTS = [f"Customer#{i:09d}" for i in range(1, 40)] + ["Customer#000000042 LTDA", "no such client"]
SCOPE_PERIODS = ["01/1997", "1996-05", "Feb-1995", "03/1994", "not a month"]
_PICKED = ", ".join(O.q(c) for c in SCOPE_CLIENTS)
_SCOPED = f"""picked AS (SELECT * FROM consolidated WHERE client IN ({_PICKED})
  OR ({O.doc_digits('doc')} <> '' AND {O.doc_digits('doc')} IN (SELECT {O.doc_digits('doc')} FROM consolidated WHERE client IN ({_PICKED}))))"""
_SCOPED_P = f"{_SCOPED}, scoped AS (SELECT * FROM picked WHERE {O.f5('period')} <> '' AND {O.f5('period')} IN ({', '.join(O.f5(O.q(p)) for p in SCOPE_PERIODS)}))"


@register("client_scope", f"{W1}, {_SCOPED} SELECT src, row_id, client, doc FROM picked")
def client_scope(spark, sf):
    return P.client_scope(T.consolidated(spark, sf), SCOPE_CLIENTS).select("src", "row_id", "client", "doc")


@register("review_metrics_scoped", f"""{W1}, {_SCOPED_P} SELECT count(*) AS total_rows,
  CAST(count_if(due_date IS NULL OR {O.lower_strip('due_date')} IN ('', 'nan', 'nat', 'none')) AS BIGINT) AS incomplete_rows FROM scoped""")
def review_metrics_scoped(spark, sf):
    return S.review_metrics(P.filter_scope(T.consolidated(spark, sf), SCOPE_CLIENTS, SCOPE_PERIODS))


@register("report_scoped", O.report_ctes(as_of=AS_OF, mode="distributor", scope_sql=(_SCOPED_P, "scoped", "picked")) + "\nSELECT * FROM report")
def report_scoped(spark, sf):
    r = RP.generate(T.consolidated(spark, sf), SCOPE_CLIENTS, SCOPE_PERIODS, T.metadata(spark, sf), _opts(grouping_mode="distributor"))
    return RP.flat_report(r)


_WANTED = ", ".join(O.f5(O.q(p)) for p in GROUP_PERIODS)


@register("filter_periods", f"""{W1} SELECT src, row_id, period FROM consolidated
  WHERE {O.f5('period')} <> '' AND {O.f5('period')} IN ({_WANTED})""")
def filter_periods(spark, sf):
    return P.period_scope(T.consolidated(spark, sf), GROUP_PERIODS).select("src", "row_id", "period")


@register("review_metrics", f"""{W1} SELECT count(*) AS total_rows,
  CAST(count_if(due_date IS NULL OR {O.lower_strip('due_date')} IN ('', 'nan', 'nat', 'none')) AS BIGINT) AS incomplete_rows
  FROM consolidated""")
def review_metrics(spark, sf):
    return S.review_metrics(T.consolidated(spark, sf))


@register("incomplete_rows", f"""{W1} SELECT CAST(uc AS VARCHAR) AS no_uc, CAST(period AS VARCHAR) AS referencia,
  client AS razao_social FROM consolidated
  WHERE due_date IS NULL OR {O.lower_strip('due_date')} IN ('', 'nan', 'nat', 'none')""")
def incomplete_rows(spark, sf):
    return S.incomplete_rows(T.consolidated(spark, sf))


# ------------------------------------------------------------------ portal restriction

_ALIAS = f"""alias AS (SELECT alias_key, arg_min(alias_uc, struct_pack(s := src, r := row_id)) AS alias_uc
  FROM (SELECT {O.uc_text('portal_uc')} AS alias_key, uc AS alias_uc, src, row_id FROM consolidated)
  WHERE alias_key IS NOT NULL AND alias_uc IS NOT NULL AND {O.contains_letter('alias_uc')} GROUP BY alias_key)"""


@register("alias_map", f"{W1}, {_ALIAS} SELECT alias_key, alias_uc FROM alias")
def alias_map(spark, sf):
    return J.alias_map(T.consolidated(spark, sf))


@register("final_unit", f"""{W1}, {_ALIAS}
SELECT c.src, c.row_id, coalesce({O.uc_text('c.portal_uc')}, a.alias_uc, {O.uc_text('c.uc')}) AS uc_final
FROM consolidated c LEFT JOIN alias a ON a.alias_key = {O.uc_text('c.uc')}""")
def final_unit(spark, sf):
    c = T.consolidated(spark, sf)
    return J.final_unit(c, J.alias_map(c)).select("src", "row_id", "uc_final")


@register("portal_restrict", _sql("SELECT src, row_id, uc, period, amount FROM portal", with_meta=False))
def portal_restrict(spark, sf):
    c = T.consolidated(spark, sf)
    return J.restrict_to_portal(c, c).select("src", "row_id", "uc", "period", "amount")


@register("enrich_left", _sql("SELECT src, row_id, uc, period, cost_center, tag FROM enriched"))
def enrich_left(spark, sf):
    c = T.consolidated(spark, sf)
    work, _ = E.enrich_left(J.restrict_to_portal(c, c), T.metadata(spark, sf), reserved=L.REPORT_NAMES)
    return work.select("src", "row_id", "uc", "period", "cost_center", "tag")


# ------------------------------------------------------------------ grouping and report

@register("report", _sql())
def report(spark, sf):
    return _report(spark, sf)


@register("group_default", _sql())
def group_default(spark, sf):
    return _report(spark, sf, grouping_mode="default")


@register("group_distributor", _sql(mode="distributor"))
def group_distributor(spark, sf):
    return _report(spark, sf, grouping_mode="distributor")


@register("group_doc", _sql(mode="cnpj"))
def group_doc(spark, sf):
    return _report(spark, sf, grouping_mode="cnpj")


@register("group_none", _sql(mode="none"))
def group_none(spark, sf):
    return _report(spark, sf, grouping_mode="none")


@register("group_no_children", _sql(mode="distributor", include_children=False))
def group_no_children(spark, sf):
    return _report(spark, sf, grouping_mode="distributor", include_child_rows=False)


@register("group_none_main_only", _sql(mode="none", include_children=False))
def group_none_main_only(spark, sf):
    return _report(spark, sf, grouping_mode="none", include_child_rows=False)


@register("classify_majority", _sql("""SELECT period, client, distributor, classification, amount, tariff, savings
  FROM report WHERE row_kind = 'parent'""", mode="distributor"))
def classify_majority(spark, sf):
    r = _report(spark, sf, grouping_mode="distributor")
    return r.filter("row_kind = 'parent'").select("period", "client", "distributor", "classification", "amount",
                                                  "tariff", "savings")


@register("sort_by_client", _sql(mode="cnpj", sort_by="client"))
def sort_by_client(spark, sf):
    return _report(spark, sf, grouping_mode="cnpj", sort_by=RP.SORT_CLIENT)


@register("sort_by_unit", _sql(mode="distributor", sort_by="uc", incomplete="complete_only"))
def sort_by_unit(spark, sf):
    return _report(spark, sf, grouping_mode="distributor", sort_by=RP.SORT_UNIT, incomplete_filter="complete_only")


@register("hide_paid", _sql(mode="distributor", only_pending=True))
def hide_paid(spark, sf):
    return _report(spark, sf, grouping_mode="distributor", only_pending=True)


@register("audit_split", _sql(mode="distributor", split_audit=True))
def audit_split(spark, sf):
    return _report(spark, sf, grouping_mode="distributor", split_audit=True)


@register("sheet_split", _sql(mode="cnpj", split_audit=True, multi_sheet=True))
def sheet_split(spark, sf):
    return _report(spark, sf, grouping_mode="cnpj", split_audit=True, presentation=L.MULTI_SHEET)


@register("summary_totals", _sql("""SELECT CAST(coalesce(sum(CAST(savings AS DECIMAL(24,6))), 0) AS DOUBLE) AS savings_total,
  CAST(coalesce(sum(CAST(amount AS DECIMAL(24,6))), 0) AS DOUBLE) AS amount_total
  FROM report WHERE row_kind NOT IN ('parent', 'separator')""", mode="distributor"))
def summary_totals(spark, sf):
    return S.summary_totals(_report(spark, sf, grouping_mode="distributor"))


@register("status_counts", _sql("""SELECT status, count(*) AS count FROM report
  WHERE row_kind NOT IN ('parent', 'separator') AND status IS NOT NULL GROUP BY status""", mode="distributor"))
def status_counts(spark, sf):
    return S.status_counts(_report(spark, sf, grouping_mode="distributor"))


_LABELS = ", ".join(f'{c} AS "{lbl}"' for c, lbl in L.REPORT_COLUMNS) + ", cost_center, tag"


@register("report_projection", _sql(f"SELECT {_LABELS} FROM report"))
def report_projection(spark, sf):
    return L.label_columns(_report(spark, sf), ["cost_center", "tag"])


_ORD_COLS = ["k", "p1", "p2", "p3", "src", "row_id"]


@register("sorted_layout", _sql(
    "SELECT g.row_kind, g.kind_rank, " + ", ".join(f"f.{c} AS go_{c}" for c in _ORD_COLS) + ", "
    + ", ".join(f"g.{c} AS o_{c}" for c in _ORD_COLS)
    + " FROM grouped g JOIN firsts f USING (g1, g2, g3)"))
def sorted_layout(spark, sf):
    r = RP.generate(T.consolidated(spark, sf), [], [], T.metadata(spark, sf), _opts())
    names = {"k": "_k", "p1": "_t0._p1", "p2": "_t0._p2", "p3": "_t0._p3", "src": "_t0.src", "row_id": "_t0.row_id"}
    cols = [F.col(f"group_ord.{v}").alias(f"go_{k}") for k, v in names.items()]
    cols += [F.col(f"ord.{v}").alias(f"o_{k}") for k, v in names.items()]
    out = RP.sorted_report(r).select("row_kind", "kind_rank", *cols)
    return out.withColumns({c: F.col(c).cast("double") for c in ["go_k", "go_p3", "o_k", "o_p3"]})


@register("report_by_month", _sql(scope="by_month", with_meta=False, mode="distributor"))
def report_by_month(spark, sf):
    r = RP.generate_by_month(T.consolidated(spark, sf), [], [], None, _opts(grouping_mode="distributor"))
    return RP.flat_report(r)


@register("report_by_group", _sql(scope="by_group"))
def report_by_group(spark, sf):
    r = RP.generate_many(T.consolidated(spark, sf), T.groups(spark, sf), T.group_periods(spark, sf), T.metadata(spark, sf), _opts())
    return RP.flat_report(r)


# ------------------------------------------------------------------ names and metadata

@register("output_names", f"""{W}, {O.GROUP_HEADS} SELECT group_id, group_name,
  {O.output_file_name('group_name', 'n', 'first', 'months')} AS file_name, {O.periods_suffix('months')} AS period_suffix FROM heads""")
def output_names(spark, sf):
    g = RP.group_names(T.groups(spark, sf), T.group_periods(spark, sf))
    return g.select("group_id", "group_name", F.col("output_name").alias("file_name"), FM.periods_suffix(F.col("periods")).alias("period_suffix"))


@register("profile_explode", f"""{W} SELECT uc, 'cost_center' AS field, cost_center AS value FROM metadata
  WHERE cost_center IS NOT NULL UNION ALL SELECT uc, 'tag', tag FROM metadata WHERE tag IS NOT NULL""")
def profile_explode(spark, sf):
    m = T.metadata(spark, sf)
    fields = F.map_filter(F.create_map(F.lit("cost_center"), F.col("cost_center"), F.lit("tag"), F.col("tag")),
                          lambda k, v: v.isNotNull())
    docs = m.select(F.to_json(F.create_map(F.col("uc"), fields)).alias("value"))
    return E.profile_rows(docs)


def _imports(spark, sf):
    b = T.base(spark, sf)
    raw = b.select(F.col("uc").alias("Instalação"), F.concat(F.lit("DIST-"), F.col("distributor")).alias("cost_center"),
                   F.col("row_id").alias("seq"))
    return E.import_rows(raw)


_IMPORTS = f"SELECT {O.strip_suffix('uc', ())} AS uc, 'DIST-' || distributor AS cost_center, row_id AS seq FROM base"


@register("metadata_upsert", f"""{W}, imp AS ({_IMPORTS}),
both_ AS (SELECT uc, cost_center, tag, seq, 0 AS batch FROM metadata
  UNION ALL SELECT uc, cost_center, NULL, seq, 1 FROM imp)
SELECT uc, cost_center, tag, seq FROM (SELECT *, row_number() OVER (PARTITION BY uc ORDER BY batch DESC, seq DESC) AS rn
  FROM both_) WHERE rn = 1""")
def metadata_upsert(spark, sf):
    return E.upsert_keep_last(T.metadata(spark, sf), _imports(spark, sf))


_LAST_META = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY uc ORDER BY seq DESC) AS rn FROM metadata) WHERE rn = 1"
_LAST_IMP = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY uc ORDER BY seq DESC) AS rn FROM ({_IMPORTS})) WHERE rn = 1"


@register("metadata_merge", f"""{W}, cur AS ({_LAST_META}), upd AS ({_LAST_IMP})
SELECT coalesce(u.uc, c.uc) AS uc, coalesce(u.cost_center, c.cost_center) AS cost_center, c.tag AS tag,
  coalesce(u.seq, c.seq) AS seq FROM cur c FULL OUTER JOIN upd u ON c.uc = u.uc""")
def metadata_merge(spark, sf):
    cur = E.keep_last(T.metadata(spark, sf))
    upd = E.keep_last(_imports(spark, sf))
    return E.merge_fields(cur, upd)


@register("metadata_delete", f"""{W}, cur AS ({_LAST_META})
SELECT uc, seq, cost_center, tag FROM cur WHERE uc NOT IN (SELECT uc FROM ({_IMPORTS}) WHERE uc IS NOT NULL)""")
def metadata_delete(spark, sf):
    cur = E.keep_last(T.metadata(spark, sf))
    return E.delete_keys(cur, _imports(spark, sf))


@register("group_clients", f"{W} SELECT DISTINCT group_id, group_name, client FROM client_groups WHERE client IS NOT NULL")
def group_clients(spark, sf):
    return E.group_clients(T.groups(spark, sf))


_BASE = ("(CASE WHEN group_name IS NOT NULL AND group_name <> '' AND NOT starts_with(group_name, 'Grupo_') THEN "
         + O.sanitize_filename("group_name", "memoria_calculo") + " WHEN n = 1 THEN " + O.sanitize_filename("first", "memoria_calculo")
         + " WHEN n > 1 THEN " + O.sanitize_filename("first || '_e_outros'", "memoria_calculo") + " ELSE 'Memoria_Calculo' END)")


@register("zip_names", f"""{W}, {O.GROUP_HEADS} SELECT h.group_id, p.period, {_BASE} AS base_name
  FROM heads h JOIN (SELECT DISTINCT group_id, period FROM group_periods) p ON p.group_id = h.group_id""")
def zip_names(spark, sf):
    g = RP.group_names(T.groups(spark, sf), T.group_periods(spark, sf)).select("group_id", "group_name", "n_clients", "first_client", F.explode("periods").alias("period"))
    return g.select("group_id", "period", FM.scope_base_name_of("group_name", F.col("n_clients"), F.col("first_client")).alias("base_name"))


# ------------------------------------------------------------------ header scan

#: Rows of one derived export file; the number of files grows with the table.
EXPORT_ROWS = 500
# Exports of a folder at most: a larger table gets larger exports, as opening and listing cost per file.
EXPORT_FILES = 512
EXPORT_HEADER = ["No. UC", "CPF/CNPJ", "Razao Social", "Referencia", "Distribuidora"]


def export_files(table, path: str, cols, order: str, header) -> None:
    """Write a table as ``;``-separated exports of about ``EXPORT_ROWS`` rows (more where that makes over ``EXPORT_FILES``
    exports) in the order of an id that begins with a number, each with junk lines above its header line (the layout S2
    must find); file names follow the order too."""
    number = F.regexp_extract(order, "^([0-9]+)", 1).cast("long")
    last = table.agg(F.max(number)).first()[0] or 0
    files = F.lpad(F.floor(number / max(EXPORT_ROWS, last // EXPORT_FILES + 1)).cast("string"), 12, "0")
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    body = table.select(files.alias("f"), F.lit(2).alias("o"), F.col(order).alias("r"), F.concat_ws(";", *[cell(c) for c in cols]).alias("value"))
    top = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(str(i)).alias("r"), F.lit(v).alias("value")) for i, (o, v) in enumerate(
        [(0, "Balanco Operacional"), (0, ";;;"), (1, ";".join(header))])])
    lines = body.unionByName(body.select("f").distinct().select("f", F.explode(top).alias("x")).select("f", "x.o", "x.r", "x.value"))
    # one folder per export: a task never mixes two exports in one file
    lines.repartition("f").sortWithinPartitions("f", "o", "r").select("value", "f").write.partitionBy("f").text(path)


def export_with_junk(base, path: str) -> None:
    """The base table as exports of the columns of ``EXPORT_HEADER``."""
    export_files(base, path, ["uc", "doc", "client", "period", "distributor"], "row_id", EXPORT_HEADER)


@register("header_scan", f"""{W} SELECT '"' || coalesce(uc, '') || '"' AS uc, '"' || coalesce(client, '') || '"' AS client, 2 AS header_line FROM base""")
def header_scan(spark, sf):
    import uuid

    from kwhrecon.session import scratch_path
    from kwhrecon.sources.readers import read_with_header
    path = scratch_path(spark, f"exports-{uuid.uuid4().hex}")
    export_with_junk(T.base(spark, sf), path)
    rows = read_with_header(spark, path)
    return rows.select(F.concat(F.lit('"'), F.col("cells")[0], F.lit('"')).alias("uc"), F.concat(F.lit('"'), F.col("cells")[2], F.lit('"')).alias("client"),
                       "header_line")
