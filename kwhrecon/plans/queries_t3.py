"""Registered queries: stored indexes, bucketed joins, sources and sinks read back, metadata in one call."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kwhrecon.functions import formats as FM
from kwhrecon.operators import enrich as E
from kwhrecon.operators import index as I
from kwhrecon.operators import layout as L
from kwhrecon.operators import reconcile as R
from kwhrecon.plans import bucketed as B
from kwhrecon.plans import metadata as M
from kwhrecon.plans import oracle as O
from kwhrecon.plans import report as RP
from kwhrecon.plans import sync as SY
from kwhrecon.plans import tables as T
from kwhrecon.plans.queries_t1 import _J_FIELDS, SEARCH_TERM, _j_fields
from kwhrecon.plans.queries_t2 import _IMPORTS, _LAST_IMP, _LAST_META, SCOPE_CLIENTS, SCOPE_PERIODS, _imports, _sql, export_files
from kwhrecon.session import scratch_path
from kwhrecon.sources import folders
from kwhrecon.sources import sinks as K
from kwhrecon.sources.readers import CHARGE_ALIASES, latest_snapshot, pruned_scan, read_export

Q: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


W = O.duckdb_ctes()
W1 = O.t1_ctes()


def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ indexes

#: Beginnings of a searched name, of 1 to 20 characters, and two terms with accents and signs.
TERMS = [("Customer#000000012 LTDA")[:n] for n in range(1, 21)] + ["ç-ustômer", SEARCH_TERM]


@register("client_search_indexed", f"""{W}, terms (place, term) AS (VALUES {', '.join(f"({i}, {O.q(t)})" for i, t in enumerate(TERMS))})
  SELECT place, row_id, client FROM base, terms WHERE contains({O.search_norm('client')}, {O.search_norm('term')})""")
def client_search_indexed(spark, sf):
    base, path = T.base(spark, sf).select("row_id", "client"), _folder(spark, "search")
    I.build_search_index(base, "client", path)
    out = None
    for i, term in enumerate(TERMS):
        rows = I.search_indexed(base, "client", path, term).select(F.lit(i).alias("place"), "row_id", "client")
        out = rows if out is None else out.unionByName(rows)
    return out


_SCOPES = [([], []), (SCOPE_CLIENTS, []), ([], SCOPE_PERIODS), (SCOPE_CLIENTS, SCOPE_PERIODS), (SCOPE_CLIENTS[:1], ["not a month"])]


def _scope_sql(i, clients, periods):
    picked, doc, month = ", ".join(map(O.q, clients)), O.doc_digits("doc"), O.f5("period")
    by_client = f"(client IN ({picked}) OR ({doc} <> '' AND {doc} IN (SELECT {doc} FROM consolidated WHERE client IN ({picked}))))" if clients else "TRUE"
    by_month = f"({month} <> '' AND {month} IN ({', '.join(O.f5(O.q(p)) for p in periods)}))" if periods else "TRUE"
    return f"""SELECT {i} AS scope, count(*) AS total_rows, coalesce(CAST(count_if(due_date IS NULL OR {O.lower_strip('due_date')} IN ('', 'nan', 'nat', 'none')) AS BIGINT), 0)
      AS incomplete_rows FROM consolidated WHERE {by_client} AND {by_month}"""


@register("review_metrics_cube", W1 + " " + " UNION ALL ".join(_scope_sql(i, c, p) for i, (c, p) in enumerate(_SCOPES)))
def review_metrics_cube(spark, sf):
    path = _folder(spark, "cube")
    I.scope_cube(T.consolidated(spark, sf)).write.parquet(path)
    out = None
    for i, (clients, periods) in enumerate(_SCOPES):
        row = I.cube_metrics(spark.read.parquet(path), clients, periods).withColumn("scope", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out


@register("dataset_metrics_sketched", f"""{W} SELECT count(DISTINCT CASE WHEN {O.f5('period')} <> '' THEN {O.f5('period')} END) AS months,
  count(*) AS rows, TRUE AS clients_within_4_percent FROM base""")
def dataset_metrics_sketched(spark, sf):
    path, base = _folder(spark, "sketches"), T.base(spark, sf)
    I.month_sketches(base).write.parquet(path)
    exact = base.agg(F.count_distinct("client").alias("exact"))
    both = I.sketched_metrics(spark.read.parquet(path)).withColumn("_k", F.lit(1)).join(exact.withColumn("_k", F.lit(1)), "_k")
    return both.select("months", "rows", (F.abs(F.col("clients") - F.col("exact")) <= 0.04 * F.col("exact")).alias("clients_within_4_percent"))


@register("bucketed_joins", f"""{W1} SELECT row_id, uc_key, CAST(period_month AS VARCHAR) AS period_month, {_J_FIELDS} FROM j3""")
def bucketed_joins(spark, sf):
    tag, buckets = uuid.uuid4().hex, int(spark.conf.get("spark.sql.shuffle.partitions"))
    B.store_bucketed(R.base_keys(T.base(spark, sf)), f"base_{tag}", buckets)
    B.store_bucketed(T.consolidation(spark, sf).deduped, f"charges_{tag}", buckets)
    return _j_fields(B.join_bucketed(spark, f"base_{tag}", f"charges_{tag}"))


# ------------------------------------------------------------------ sources

@register("pruned_scan", f"{W} SELECT uc, client, period FROM base")
def pruned_scan_q(spark, sf):
    """A stored table with blanks around its column names, read by the required ones."""
    path, base = _folder(spark, "wide"), T.base(spark, sf)
    base.select(*[F.col(c).alias(f" {c} ") for c in base.columns]).write.option("header", True).option("nullValue", "\\N").csv(path)
    return pruned_scan(spark, path, ["uc", "client", "period"], fmt="csv", header=True, nullValue="\\N", ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False, emptyValue="")


@register("latest_snapshot", f"{W}, cur AS ({_LAST_META}) SELECT uc, seq, cost_center, tag FROM cur")
def latest_snapshot_q(spark, sf):
    """Three snapshots of several files each; the last one lacks the marker of a finished write."""
    root, meta = _folder(spark, "snapshots"), T.metadata(spark, sf)
    meta.limit(0).repartition(3).write.parquet(f"{root}/2031-01")
    E.keep_last(meta).repartition(5).write.parquet(f"{root}/2031-02")
    meta.repartition(4).write.parquet(f"{root}/2031-03")
    folders.delete(spark, f"{root}/2031-03/_SUCCESS")
    return latest_snapshot(spark, root).select("uc", "seq", "cost_center", "tag")


_FILE_COLS = ["src", "uc", "portal_uc", "period", "due_date", "status", "account", "paid_date", "is_dup"]


@register("sync_from_files", f"""{W1} SELECT {', '.join(_FILE_COLS)}, CAST(charged_amount AS DOUBLE) AS charged_amount,
  nullif(client, '') AS client, nullif(doc, '') AS doc, distributor FROM consolidated""")
def sync_from_files(spark, sf):
    """T1 from export files below junk and header lines; ties and first donors follow the order of rows in the files."""
    out = _folder(spark, "files")
    base = T.base(spark, sf)
    order = {"base": "row_id", "charges": "charge_id"}
    names = {"uc": "No. UC", "doc": "CPF/CNPJ"}
    export_files(base, f"{out}/base", [c for c in base.columns if c in SY.BASE_ALIASES], order["base"],
                 [names.get(c, SY.BASE_ALIASES[c][0]) for c in base.columns if c in SY.BASE_ALIASES])
    charges = T.charges(spark, sf)
    export_files(charges, f"{out}/charges", [c for c in charges.columns if c in CHARGE_ALIASES], order["charges"],
                 [CHARGE_ALIASES[c][0] for c in charges.columns if c in CHARGE_ALIASES])
    cons = SY.sync(read_export(spark, f"{out}/base"), read_export(spark, f"{out}/charges", markers=["instalação", "vencimento"]), f"{out}/table", f"{out}/gaps")
    return cons.select(*_FILE_COLS, F.col("charged_amount").cast("double").alias("charged_amount"), "client", "doc", "distributor")


# ------------------------------------------------------------------ sinks read back

@register("gap_report_written", f"""{W1}, g AS (SELECT CAST(uc AS VARCHAR) AS no_uc, CAST(period AS VARCHAR) AS referencia, client AS razao_social, doc AS cpf_cnpj,
  CASE WHEN c.uc_key IN (SELECT uc_key FROM unit_keys) THEN 'PERIODO_NAO_LANCADO' ELSE 'UC_AUSENTE_NA_GESTAO' END AS tipo
  FROM consolidated c WHERE due_date IS NULL)
  SELECT *, (SELECT count(*) FROM g) AS total, row_number() OVER (ORDER BY tipo, referencia, no_uc, razao_social, cpf_cnpj) > 0 AS in_order FROM g""")
def gap_report_written(spark, sf):
    """Items and header as written; whether the items of each file follow type and month."""
    path = _folder(spark, "gaps")
    K.write_gap_report(T.consolidation(spark, sf).gaps, path, "1996-06-01T00:00:00")
    from pyspark.sql import Window
    items = spark.read.schema("no_uc string, referencia string, razao_social string, cpf_cnpj string, tipo string").json(f"{path}/items")
    items = items.withColumns({"_f": F.input_file_name(), "_n": F.monotonically_increasing_id()})
    before = F.lag(F.struct("tipo", "referencia")).over(Window.partitionBy("_f").orderBy("_n"))
    total = spark.read.json(f"{path}/header").select(F.lit(1).alias("_k"), F.col("total_ucs_sem_vencimento").alias("total"))
    out = items.withColumn("in_order", F.coalesce(before <= F.struct("tipo", "referencia"), F.lit(True))).withColumn("_k", F.lit(1)).join(total, "_k")
    return out.select("no_uc", "referencia", "razao_social", "cpf_cnpj", "tipo", "total", "in_order")


_WRITTEN = [(c, lbl) for c, lbl in L.REPORT_COLUMNS if c in ("period", "uc", "client", "due_date", "status", "classification")]
_OUT = dict(mode="distributor", split_audit=True, multi_sheet=True)


def _split_report(spark, sf):
    opts = RP.ReportOptions(as_of="1996-06-01", grouping_mode="distributor", split_audit=True, presentation=L.MULTI_SHEET)
    return RP.generate(T.consolidated(spark, sf), [], [], T.metadata(spark, sf), opts)


@register("report_written", _sql("SELECT sheet, " + ", ".join(f"nullif({c}, '') AS {c}" for c, _ in _WRITTEN) + f""",
  CAST(amount AS DOUBLE) AS amount FROM report""", **_OUT))
def report_written(spark, sf):
    """K5, V2: the rows as written, one folder per sheet."""
    path = _folder(spark, "report")
    K.write_outputs(_split_report(spark, sf), path)
    rows = spark.read.option("header", True).option("recursiveFileLookup", False).csv(f"{path}/rows")
    labels = dict(L.REPORT_COLUMNS)
    return rows.select("sheet", *[F.col(f"`{lbl}`").alias(c) for c, lbl in _WRITTEN], F.col(f"`{labels['amount']}`").cast("double").alias("amount"))


@register("report_marks", _sql(f"""SELECT sheet, period, uc, row_kind, row_kind <> 'separator' AND ({O.blank('due_date')} OR {O.blank('status')}) AS missing_mark,
  CASE WHEN row_kind <> 'separator' AND ({O.blank('due_date')} OR {O.blank('status')}) THEN {O.q(L.MISSING_NOTE)} END AS missing_note FROM report""", **_OUT))
def report_marks(spark, sf):
    """C6 on the rows of the report."""
    return L.missing_marks(_split_report(spark, sf)).select("sheet", "period", "uc", "row_kind", "missing_mark", "missing_note")


_STATES = "('Pago'), ('Atrasado'), ('Em aberto'), ('Negociado')"


@register("report_totals_written", _sql(f"""SELECT s.status, count(r.status) AS count, any_value(t.savings_total) AS savings_total, any_value(t.amount_total) AS amount_total
  FROM (VALUES {_STATES}) s(status) JOIN (SELECT status FROM report WHERE row_kind NOT IN ('parent', 'separator')) r ON r.status = s.status,
  (SELECT CAST(coalesce(sum(CAST(savings AS DECIMAL(24,6))), 0) AS DOUBLE) AS savings_total, CAST(coalesce(sum(CAST(amount AS DECIMAL(24,6))), 0) AS DOUBLE) AS amount_total
   FROM report WHERE row_kind NOT IN ('parent', 'separator')) t GROUP BY s.status""", **_OUT))
def report_totals_written(spark, sf):
    """The summary and status counts observed while the report was written."""
    path = _folder(spark, "report")
    K.write_outputs(_split_report(spark, sf), path)
    total = spark.read.json(f"{path}/summary").withColumn("_k", F.lit(1))
    return spark.read.json(f"{path}/status").withColumn("_k", F.lit(1)).join(total, "_k").select("status", "count", "savings_total", "amount_total")


@register("outputs_by_group_and_month", _sql("""SELECT output_name AS written_name, period AS written_period, count(*) AS rows
  FROM (SELECT output_name, period FROM report WHERE row_kind <> 'separator') GROUP BY ALL""", scope="by_group"))
def outputs_by_group_and_month(spark, sf):
    """K3, K4: one folder per saved group and month, counted as read back."""
    path = _folder(spark, "outputs")
    r = RP.generate_many(T.consolidated(spark, sf), T.groups(spark, sf), T.group_periods(spark, sf), T.metadata(spark, sf), RP.ReportOptions(as_of="1996-06-01"))
    r = r.where("row_kind <> 'separator'").withColumns({"written_name": F.col("output_name"), "written_period": F.col("period")})
    K.write_report(r, path, by=("written_name", "written_period"), fmt="parquet", extra_keys=RP.GROUP_KEYS)
    back = spark.read.option("basePath", path).parquet(path)
    return back.groupBy(F.col("written_name").cast("string").alias("written_name"), F.col("written_period").cast("string").alias("written_period")).agg(F.count("*").alias("rows"))


@register("client_group_saved", f"""{W} SELECT group_id, group_name, client FROM client_groups WHERE group_id <> 3
  UNION ALL SELECT 3, 'Carteira Nova', client FROM (SELECT DISTINCT c_name AS client FROM customer WHERE c_custkey % 50 = 0)""")
def client_group_saved(spark, sf):
    """K9: a saved group replaced by new clients."""
    clients = [r[0] for r in T.base(spark, sf).sparkSession.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 50 = 0").select("c_name").distinct().collect()]
    out = K.save_client_group(T.groups(spark, sf), 3, "Carteira Nova", clients)
    return out.select("group_id", "group_name", "client")


@register("zip_entry_names", f"""{W}, {O.GROUP_HEADS} SELECT h.group_id, p.period, {O.zip_entry('group_name', 'n', 'first', 'p.period')} AS entry_name,
  {O.suggested('group_name', 'n', 'first', 'months')} AS suggested FROM heads h JOIN (SELECT DISTINCT group_id, period FROM group_periods) p ON p.group_id = h.group_id""")
def zip_entry_names(spark, sf):
    """entry and suggested names of saved groups."""
    g = RP.group_names(T.groups(spark, sf), T.group_periods(spark, sf)).withColumn("period", F.explode("periods"))
    return g.select("group_id", "period", FM.zip_entry_name_of("group_name", F.col("n_clients"), F.col("first_client"), "period").alias("entry_name"),
                    FM.suggested_name_of("group_name", F.col("n_clients"), F.col("first_client"), F.col("periods")).alias("suggested"))


@register("group_flagged_only", _sql("SELECT period, client, row_kind, uc, amount FROM report", flagged_only=True))
def group_flagged_only(spark, sf):
    """A1 without commercial ids and alternative units: flagged rows of a client and month form one group."""
    cons = T.consolidated(spark, sf).drop("commercial_id", "alt_uc")
    r = RP.flat_report(RP.generate(cons, [], [], T.metadata(spark, sf), RP.ReportOptions(as_of="1996-06-01")))
    return r.select("period", "client", "row_kind", "uc", "amount")


# ------------------------------------------------------------------ metadata

def _import_file(spark, sf, path):
    b = T.base(spark, sf)
    rows = b.select(F.col("uc").alias("Instalação "), F.concat(F.lit("DIST-"), F.col("distributor")).alias("cost_center"), F.col("row_id"))
    rows.repartitionByRange(1, "row_id").sortWithinPartitions("row_id").drop("row_id").write.option("sep", ";").option("header", True).csv(path)


@register("metadata_import", f"""{W}, cur AS ({_LAST_META}), imp AS ({_LAST_IMP})
SELECT coalesce(i.uc, c.uc) AS uc, CASE WHEN i.uc IS NOT NULL THEN i.cost_center ELSE c.cost_center END AS cost_center,
  CASE WHEN i.uc IS NULL THEN c.tag END AS tag FROM cur c FULL OUTER JOIN (SELECT * FROM imp WHERE uc IS NOT NULL) i ON c.uc = i.uc""")
def metadata_import(spark, sf):
    """An export file imported into a profile that has rows; the profile as read back."""
    path = _folder(spark, "import")
    K.save_profile(E.keep_last(T.metadata(spark, sf)).drop("seq"), f"{path}/profiles", "Perfil A")
    K.save_profile(T.metadata(spark, sf).select("uc", "tag"), f"{path}/profiles", "Perfil B")
    _import_file(spark, sf, f"{path}/file")
    M.import_metadata(spark, f"{path}/file", f"{path}/profiles", "Perfil A")
    return M.read_profiles(spark, f"{path}/profiles").where("profile = 'Perfil A'").select("uc", "cost_center", "tag")


@register("metadata_maintenance", f"""{W}, cur AS ({_LAST_META}), upd AS ({_LAST_IMP}),
merged AS (SELECT coalesce(u.uc, c.uc) AS uc, coalesce(u.cost_center, c.cost_center) AS cost_center, c.tag AS tag FROM cur c FULL OUTER JOIN upd u ON c.uc = u.uc)
SELECT uc, cost_center, tag FROM merged WHERE uc NOT IN (SELECT uc FROM metadata WHERE tag IS NULL AND uc IS NOT NULL)""")
def metadata_maintenance(spark, sf):
    """Documents saved (K7), some deleted (K8), the current snapshot read back."""
    docs, meta = M.Documents(spark, _folder(spark, "documents")), T.metadata(spark, sf)
    docs.start(E.keep_last(meta).drop("seq"))
    docs.save(E.keep_last(_imports(spark, sf)).drop("seq"))
    docs.delete(meta.where("tag is null").select("uc").distinct())
    return docs.current().select("uc", "cost_center", "tag")


@register("profile_lists", f"""{W}, primary_ AS (SELECT DISTINCT 'P' || group_id AS profile FROM client_groups), local_ AS (SELECT DISTINCT 'P' || (group_id + 10) AS profile FROM client_groups)
SELECT profile, profile IN (SELECT profile FROM primary_) AS in_primary FROM (SELECT profile FROM primary_ UNION SELECT profile FROM local_)""")
def profile_lists(spark, sf):
    """Names of both stores, and which rows a read with fallback takes from the primary one."""
    from kwhrecon.sources.readers import load_profile
    g = T.groups(spark, sf)
    primary = g.select(F.concat(F.lit("P"), "group_id").alias("profile"), F.lit(True).alias("in_primary")).distinct()
    local = g.select(F.concat(F.lit("P"), F.col("group_id") + 10).alias("profile"), F.lit(False).alias("in_primary")).distinct()
    names = E.profile_names(primary, local)
    return names.join(load_profile(primary, local), "profile")
