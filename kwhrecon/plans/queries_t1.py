"""Registered queries: column functions, sources and the consolidation.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql)``;
``duckdb_sql`` is None for queries checked by row count only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kwhrecon.functions import dates as D
from kwhrecon.functions import formats as FM
from kwhrecon.functions import keys as K
from kwhrecon.functions import money as M
from kwhrecon.operators import reconcile as R
from kwhrecon.operators import summary as S
from kwhrecon.operators import filters as P
from kwhrecon.operators import layout as L
from kwhrecon.operators import payment as C
from kwhrecon.plans import oracle as O
from kwhrecon.plans import sync as SY
from kwhrecon.plans import tables as T
from kwhrecon.plans.consolidate import consolidate, gap_report_items
from kwhrecon.session import scratch_path
from kwhrecon.sources.readers import CHARGE_ALIASES
from kwhrecon.streaming.refresh import refresh_batch

Q: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


W = O.duckdb_ctes()
W1 = O.t1_ctes()


def ds(col):  # date -> text, both engines
    return F.col(col).cast("string")


# ------------------------------------------------------------------ column functions

@register("normalize_keys", f"""{W} SELECT row_id, {O.uc_key('uc')} AS uc_key, {O.portal_uc('uc')} AS portal_uc,
  {O.uc_text('uc')} AS uc_text, {O.doc_digits('doc')} AS doc_key, {O.identity_key('uc')} AS identity_key,
  {O.contains_letter('uc')} AS has_letter, {O.strip_suffix('commercial_id')} AS commercial_clean,
  {O.gkt('client')} AS client_key, {O.uc_key('alt_uc')} AS alt_key FROM base""")
def normalize_keys(spark, sf):
    b = T.base(spark, sf)
    return b.select("row_id", K.uc_key("uc").alias("uc_key"), K.portal_uc("uc").alias("portal_uc"),
                    K.uc_text("uc").alias("uc_text"), K.doc_digits("doc").alias("doc_key"),
                    K.identity_key("uc").alias("identity_key"), K.contains_letter("uc").alias("has_letter"),
                    K.strip_decimal_suffix("commercial_id").alias("commercial_clean"),
                    K.group_key_text("client").alias("client_key"), K.uc_key("alt_uc").alias("alt_key"))


@register("parse_dates", f"""{W} SELECT charge_id, CAST({O.f1('due_date')} AS VARCHAR) AS due_parsed,
  {O.f3('due_date')} AS due_text, CAST({O.f1('paid_date')} AS VARCHAR) AS paid_parsed,
  {O.f2('period')} AS period_norm, CAST({O.f6('period')} AS VARCHAR) AS period_month FROM charges""")
def parse_dates(spark, sf):
    c = T.charges(spark, sf)
    return c.select("charge_id", D.parse_full_date("due_date").cast("string").alias("due_parsed"),
                    D.format_full_date("due_date").alias("due_text"),
                    D.parse_full_date("paid_date").cast("string").alias("paid_parsed"),
                    D.parse_reference_period("period").alias("period_norm"),
                    D.period_month("period").cast("string").alias("period_month"))


_F7 = "regexp_replace(" + O.strip(O.f4("period")) + ", '-', '/', 'g')"


@register("parse_periods", f"""{W} SELECT row_id, {O.f2('period')} AS period_norm, {O.f4('period')} AS period_text,
  {O.f5('period')} AS period_value, CAST({O.f6('period')} AS VARCHAR) AS period_month,
  CAST({O.f1('period')} AS VARCHAR) AS period_date,
  CASE WHEN regexp_matches({_F7}, '^(\\d+)/(\\d+)$') AND try_cast(regexp_extract({_F7}, '^(\\d+)/(\\d+)$', 1) AS INTEGER) BETWEEN 1 AND 12
       AND try_cast(regexp_extract({_F7}, '^(\\d+)/(\\d+)$', 2) AS INTEGER) IS NOT NULL
       THEN try_cast(regexp_extract({_F7}, '^(\\d+)/(\\d+)$', 2) AS INTEGER) ELSE 9999 END AS sort_year
  FROM base""")
def parse_periods(spark, sf):
    b = T.base(spark, sf)
    return b.select("row_id", D.parse_reference_period("period").alias("period_norm"),
                    D.format_reference_period("period").alias("period_text"),
                    D.normalize_period_value("period").alias("period_value"),
                    D.period_month("period").cast("string").alias("period_month"),
                    D.parse_full_date("period").cast("string").alias("period_date"),
                    D.period_sort_key(D.format_reference_period("period"))["year"].alias("sort_year"))


@register("parse_money", f"""{W} SELECT row_id, CAST({O.br('savings')} AS DOUBLE) AS savings_value,
  CAST({O.br('savings', 0)} AS DOUBLE) AS savings_or_zero, CAST({O.br('amount', None, True)} AS DOUBLE) AS amount_value
  FROM base""")
def parse_money(spark, sf):
    b = T.base(spark, sf)
    return b.select("row_id", M.br_number("savings").cast("double").alias("savings_value"),
                    M.br_number("savings", 0).cast("double").alias("savings_or_zero"),
                    M.br_number("amount", dtype=b.schema["amount"].dataType).cast("double").alias("amount_value"))


_STRICT = ("(CASE WHEN regexp_matches(replace(replace(" + O.strip("charged_amount") + ", '.', ''), ',', '.'), "
           "'^[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$') THEN try_cast(replace(replace(" + O.strip("charged_amount")
           + ", '.', ''), ',', '.') AS DECIMAL(18,2)) END)")


@register("charge_money", f"""{W} SELECT charge_id, CAST({O.br('charged_amount', kind='18,2')} AS DOUBLE) AS charged_value,
  CAST({_STRICT} AS DOUBLE) AS charged_strict FROM charges""")
def charge_money(spark, sf):
    c = T.charges(spark, sf)
    return c.select("charge_id", M.charge_money("charged_amount").cast("double").alias("charged_value"),
                    M.charge_money("charged_amount", strict_br=True).cast("double").alias("charged_strict"))


@register("format_documents", f"""{W} SELECT row_id, {O.format_document('doc')} AS doc_text,
  greatest(CAST({O.br('tariff')} AS DOUBLE), 0.0) AS tariff_out FROM base""")
def format_documents(spark, sf):
    b = T.base(spark, sf)
    return b.select("row_id", FM.format_document("doc").alias("doc_text"),
                    M.clamp_non_negative(M.br_number("tariff")).alias("tariff_out"))


@register("account_text", f"""{W} SELECT charge_id, {O.account_text('account')} AS account_text,
  {O.strip_suffix('account')} AS account_key FROM charges""")
def account_text(spark, sf):
    c = T.charges(spark, sf)
    return c.select("charge_id", K.account_text("account").alias("account_text"),
                    K.strip_decimal_suffix("account").alias("account_key"))


@register("cancel_filter", f"""{W} SELECT charge_id, uc, period FROM charges
  WHERE coalesce({O.lower_strip('cancelled')} <> 'sim', true)""")
def cancel_filter(spark, sf):
    return R.drop_cancelled(T.charges(spark, sf)).select("charge_id", "uc", "period")


# ------------------------------------------------------------------ consolidation

@register("charge_dedup", f"""{W1} SELECT uc_key, CAST(period_month AS VARCHAR) AS period_month, charge_id,
  due_date, is_dup, dup_count FROM deduped""")
def charge_dedup(spark, sf):
    d = T.consolidation(spark, sf).deduped
    return d.select("uc_key", ds("period_month").alias("period_month"), "charge_id", "due_date", "is_dup",
                    "dup_count")


@register("charge_dup_stats", f"""{W1} SELECT count(*) AS distinct_keys, count_if(n > 1) AS duplicated_keys,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows
  FROM (SELECT uc_key, period_month, count(*) AS n FROM charges_k WHERE active AND period_month IS NOT NULL
        GROUP BY uc_key, period_month)""")
def charge_dup_stats(spark, sf):
    ck = R.charge_keys(T.charges(spark, sf))
    return R.duplicate_stats(R.drop_cancelled(ck))


_J_FIELDS = "due_date, charge_status, CAST(charged_amount AS DOUBLE) AS charged_amount, account, portal_uc, is_dup"


def _j_fields(df):
    return df.select("row_id", "uc_key", ds("period_month").alias("period_month"), "due_date", "charge_status",
                     F.col("charged_amount").cast("double").alias("charged_amount"), "account", "portal_uc",
                     "is_dup")


@register("primary_join", f"""{W1} SELECT row_id, uc_key, CAST(period_month AS VARCHAR) AS period_month,
  {_J_FIELDS} FROM j1""")
def primary_join(spark, sf):
    res = T.consolidation(spark, sf)
    return _j_fields(R.primary_join(R.base_keys(T.base(spark, sf)), res.deduped))


@register("fallback_join", f"""{W1} SELECT row_id, uc_key, CAST(period_month AS VARCHAR) AS period_month,
  {_J_FIELDS} FROM j3""")
def fallback_join(spark, sf):
    res = T.consolidation(spark, sf)
    j = R.primary_join(R.base_keys(T.base(spark, sf)), res.deduped)
    return _j_fields(R.fallback_join(j, res.deduped))


@register("uc_only_join", f"""{W1},
ranked_uc AS (SELECT *, row_number() OVER (PARTITION BY uc_key ORDER BY due_d DESC NULLS LAST, charge_id) AS rn2,
   count(*) OVER (PARTITION BY uc_key) AS n2 FROM charges_k WHERE active)
SELECT b.row_id, b.uc_key, d.due_date, d.charge_status, CAST(d.charged_amount AS DOUBLE) AS charged_amount,
  d.account, d.portal_uc, d.n2 > 1 AS is_dup
FROM base_k b LEFT JOIN (SELECT * FROM ranked_uc WHERE rn2 = 1) d ON b.uc_key = d.uc_key""")
def uc_only_join(spark, sf):
    ck = R.charge_keys(T.charges(spark, sf)).drop("period_month")
    d = R.dedupe_charges(ck, keys=["uc_key"], active=R.active_charge())
    d = R.deduped_view(d, ["uc_key"])
    j = R.primary_join(R.base_keys(T.base(spark, sf)), d, by_month=False)
    return j.select("row_id", "uc_key", "due_date", "charge_status",
                    F.col("charged_amount").cast("double").alias("charged_amount"), "account", "portal_uc", "is_dup")


@register("portal_append", f"""{W1} SELECT row_id, uc, period, doc, CAST(charged_amount AS DOUBLE) AS charged_amount,
  due_date FROM appended""")
def portal_append(spark, sf):
    res = T.consolidation(spark, sf)
    rows = R.portal_only_charges(res.deduped, R.base_keys(T.base(spark, sf)))
    return rows.select("row_id", "uc", "period", "doc", F.col("charged_amount").cast("double").alias("charged_amount"),
                       "due_date")


_CONS_COLS = ["src", "row_id", "unit_id", "uc", "alt_uc", "portal_uc", "period", "doc", "client", "distributor",
              "amount", "savings", "tariff", "commercial_id", "group_flag", "main_flag", "source", "due_date",
              "status", "account", "paid_date", "is_dup", "uc_key"]


def _cons_select(df):
    return df.select(*_CONS_COLS, ds("period_month").alias("period_month"),
                     F.col("charged_amount").cast("double").alias("charged_amount"))


_CONS_SQL = (", ".join(_CONS_COLS) + ", CAST(period_month AS VARCHAR) AS period_month, "
             "CAST(charged_amount AS DOUBLE) AS charged_amount")


@register("consolidate", f"{W1} SELECT {_CONS_SQL} FROM consolidated")
def consolidate_q(spark, sf):
    return _cons_select(T.consolidated(spark, sf))


# T1 from the raw exports: their headers, ids from content, guard, types, the stored table read back
_MD5 = lambda cols: "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + "))"
_EXPORTED = ["src", "unit_id", "uc", "alt_uc", "portal_uc", "period", "doc", "client", "distributor", "amount", "savings", "tariff",
             "cost_with_gd", "contract_discount", "commercial_id", "group_flag", "main_flag", "source", "due_date", "status", "account", "paid_date", "is_dup"]


@register("consolidate_from_exports", O.t1_ctes(_MD5(SY.BASE_ID), _MD5(SY.CHARGE_ID)) + f""" SELECT {", ".join(_EXPORTED)},
  CAST(charged_amount AS DOUBLE) AS charged_amount, try_cast(consumed_credit AS DOUBLE) AS consumed_credit FROM consolidated""")
def consolidate_from_exports(spark, sf):
    out = scratch_path(spark, f"sync-{uuid.uuid4().hex}")
    base, charges = T.base(spark, sf).drop("row_id"), T.charges(spark, sf).drop("charge_id")
    base = base.select(*[F.col(c).alias(f" {SY.BASE_ALIASES[c][0].title()}") for c in base.columns])
    charges = charges.select(*[F.col(c).alias(f"{CHARGE_ALIASES[c][0].capitalize()} ") for c in charges.columns])
    cons = SY.sync(base, charges, f"{out}/table", f"{out}/gaps", "1996-06-01T00:00:00")
    return cons.select(*_EXPORTED, F.col("charged_amount").cast("double").alias("charged_amount"), "consumed_credit")


@register("refresh_in_batches", f"{W1} SELECT {_CONS_SQL} FROM consolidated")
def refresh_in_batches(spark, sf):
    """The charges arrive in three batches, the second one twice; the table is as after a full run."""
    out = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    base, charges = T.base(spark, sf), T.charges(spark, sf)
    part = F.pmod(F.crc32("charge_id"), F.lit(3))
    for epoch in (0, 1, 1, 2):
        refresh_batch(spark, charges.where(part == epoch), epoch, base, f"{out}/store", f"{out}/table")
    return _cons_select(spark.read.parquet(f"{out}/table"))


@register("consolidate_without_months", f"""{W1},
ranked_uc AS (SELECT *, row_number() OVER (PARTITION BY uc_key ORDER BY due_d DESC NULLS LAST, charge_id) AS rn2 FROM charges_k WHERE active)
SELECT b.row_id, b.uc, b.period, d.due_date, coalesce(d.charge_status, b.status) AS status, CAST(d.charged_amount AS DOUBLE) AS charged_amount
FROM base_k b LEFT JOIN (SELECT * FROM ranked_uc WHERE rn2 = 1) d ON b.uc_key = d.uc_key""")
def consolidate_without_months(spark, sf):
    cons = consolidate(T.base(spark, sf), T.charges(spark, sf).drop("period")).consolidated
    return cons.select("row_id", "uc", "period", "due_date", "status", F.col("charged_amount").cast("double").alias("charged_amount"))


@register("identity_backfill", f"""{W1} SELECT src, row_id, client, doc, distributor, unit_id FROM consolidated""")
def identity_backfill(spark, sf):
    return T.consolidated(spark, sf).select("src", "row_id", "client", "doc", "distributor", "unit_id")


@register("status_precedence", f"""{W1} SELECT src, row_id, status, account FROM consolidated""")
def status_precedence(spark, sf):
    return T.consolidated(spark, sf).select("src", "row_id", "status", "account")


@register("gap_report", f"""{W1} SELECT CAST(uc AS VARCHAR) AS no_uc, CAST(period AS VARCHAR) AS referencia,
  client AS razao_social, doc AS cpf_cnpj,
  CASE WHEN c.uc_key IN (SELECT uc_key FROM unit_keys) THEN 'PERIODO_NAO_LANCADO' ELSE 'UC_AUSENTE_NA_GESTAO' END AS tipo
  FROM consolidated c WHERE due_date IS NULL""")
def gap_report(spark, sf):
    return gap_report_items(T.consolidation(spark, sf).gaps)


@register("gap_summary", f"""{W1} SELECT tipo, count(*) AS total FROM (
  SELECT CASE WHEN c.uc_key IN (SELECT uc_key FROM unit_keys) THEN 'PERIODO_NAO_LANCADO' ELSE 'UC_AUSENTE_NA_GESTAO' END AS tipo
  FROM consolidated c WHERE due_date IS NULL) GROUP BY tipo""")
def gap_summary(spark, sf):
    items = gap_report_items(T.consolidation(spark, sf).gaps)
    return items.groupBy("tipo").agg(F.count(F.lit(1)).alias("total")).orderBy("tipo")


@register("expansion_stats", f"""{W1} SELECT (SELECT count(*) FROM base) AS base_rows, count(*) AS rows,
  count_if(due_date IS NULL) AS rows_without_due, count(*) - (SELECT count(*) FROM base) AS extra_rows,
  NOT (count(*) > 2 * (SELECT count(*) FROM base)) AS guard_ok FROM consolidated""")
def expansion_stats(spark, sf):
    return R.expansion_stats(T.base(spark, sf), T.consolidated(spark, sf))


@register("missing_marks", f"""{W1} SELECT src, row_id, ({O.blank('due_date')} OR lower({O.strip('due_date')}) IN ('nan','nat','none')
  OR {O.blank('status')} OR lower({O.strip('status')}) IN ('nan','nat','none')) AS missing_mark FROM consolidated""")
def missing_marks(spark, sf):
    return L.missing_marks(T.consolidated(spark, sf)).select("src", "row_id", "missing_mark")


_PAY_S = f"coalesce({O.lower_strip('status')}, '')"
_PAID_D = f"(CASE WHEN NOT coalesce({O.lower_strip('paid_date')} IN ('', '-', 'n/a', 'não', 'none', 'nan', 'nat'), false) THEN {O.f1('paid_date')} END)"
_NEG = f"(contains({_PAY_S}, 'negociad') OR contains({_PAY_S}, 'acordo'))"
_ISPAID = f"(contains({_PAY_S}, 'pago') OR {_PAID_D} IS NOT NULL)"
AS_OF = "1996-06-01"


def pay_sql(alias=""):
    return f"""CASE WHEN {_NEG} THEN 'Negociado' WHEN {_ISPAID} THEN 'Pago'
    WHEN {O.f1('due_date')} < DATE '{AS_OF}' THEN 'Atrasado' ELSE 'Em aberto' END AS status,
  CASE WHEN NOT {_NEG} AND {_ISPAID} THEN coalesce(strftime({_PAID_D}, '%d-%m-%Y'), '') END AS paid_date,
  {O.f3('due_date')} AS due_date,
  CASE WHEN period IS NULL THEN NULL ELSE {O.f4('period')} END AS period"""


@register("payment_status", f"""{W1} SELECT src, row_id, {pay_sql()} FROM consolidated""")
def payment_status(spark, sf):
    out = C.payment_rules(T.consolidated(spark, sf), as_of=AS_OF)
    return out.select("src", "row_id", "status", "paid_date", "due_date", "period")


# ------------------------------------------------------------------ scope options and metrics

@register("clients", f"{W} SELECT DISTINCT CAST(client AS VARCHAR) AS client FROM base WHERE client IS NOT NULL")
def clients(spark, sf):
    return S.clients(T.base(spark, sf))


@register("periods", f"""{W} SELECT period, CAST(split_part(period, '/', 2) AS INTEGER) AS sort_year,
  CAST(split_part(period, '/', 1) AS INTEGER) AS sort_month FROM (SELECT DISTINCT {O.f5('period')} AS period FROM base)
  WHERE period <> '' AND regexp_matches(period, '^(0[1-9]|1[0-2])/\\d{{4}}$')
  UNION ALL SELECT period, 9999, 99 FROM (SELECT DISTINCT {O.f5('period')} AS period FROM base)
  WHERE period <> '' AND NOT regexp_matches(period, '^(0[1-9]|1[0-2])/\\d{{4}}$')""")
def periods(spark, sf):
    return S.periods(T.base(spark, sf))


@register("dataset_metrics", f"""{W} SELECT count(DISTINCT client) AS clients,
  count(DISTINCT CASE WHEN {O.f5('period')} <> '' THEN {O.f5('period')} END) AS months, count(*) AS rows FROM base""")
def dataset_metrics(spark, sf):
    return S.dataset_metrics(T.base(spark, sf))


@register("flag_counts", f"{W} SELECT group_flag AS value, count(*) AS count FROM base GROUP BY group_flag")
def flag_counts(spark, sf):
    return S.value_counts(T.base(spark, sf), "group_flag")


@register("multi_unit_docs", f"""{W} SELECT doc, distributor, count(DISTINCT uc) AS units FROM base
  GROUP BY doc, distributor HAVING count(DISTINCT uc) > 1""")
def multi_unit_docs(spark, sf):
    return S.multi_unit_docs(T.base(spark, sf))


@register("flagged_counts", f"""{W} SELECT count(*) AS rows, count(alt_uc) AS with_alt_uc,
  count_if(main_flag = 'Y') AS main_rows, count(commercial_id) AS with_commercial_id
  FROM base WHERE group_flag = 'Agrupamento'""")
def flagged_counts(spark, sf):
    return S.flagged_counts(T.base(spark, sf))


SEARCH_TERM = "çustomer 00000012"


@register("client_search", f"""{W} SELECT row_id, client FROM base
  WHERE contains({O.search_norm('client')}, {O.search_norm(O.q(SEARCH_TERM))})""")
def client_search(spark, sf):
    return P.search_filter(T.base(spark, sf), "client", SEARCH_TERM).select("row_id", "client")


@register("contains_search", f"""{W} SELECT row_id, client, group_flag FROM base
  WHERE coalesce(contains(lower(client), 'ltda'), false) AND group_flag IS NOT NULL AND group_flag <> ''""")
def contains_search(spark, sf):
    b = T.base(spark, sf)
    return b.filter(P.contains_ci("client", "LTDA") & P.filled("group_flag")).select("row_id", "client", "group_flag")


@register("unit_client_pairs", f"{W} SELECT DISTINCT uc, client FROM base")
def unit_client_pairs(spark, sf):
    return S.unit_client_pairs(T.base(spark, sf))


_NUM_RE = "'^\\s*[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][-+]?[0-9]+)?\\s*$'"
_TI_COLS = ["row_id", "savings", "tariff", "consumed_credit", "commercial_id", "main_flag", "source"]


@register("type_inference", f"""{W} SELECT column_name AS "column", non_null, numeric,
  numeric >= 0.8 * non_null AS converted, CASE WHEN numeric >= 0.8 * non_null THEN non_null - numeric ELSE 0 END AS lost
  FROM ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, count({c}) AS non_null, count_if(regexp_matches({c}, {_NUM_RE})) AS numeric FROM base" for c in _TI_COLS)})""")
def type_inference(spark, sf):
    return S.type_inference_stats(T.base(spark, sf))


_PROFILE = {"row_id": "string", "unit_id": "string", "uc": "string", "alt_uc": "string", "period": "string", "doc": "string",
            "client": "string", "distributor": "string", "amount": "double", "savings": "string", "tariff": "string",
            "consumed_credit": "string", "cost_with_gd": "double", "cost_without_gd": "double", "contract_discount": "string",
            "status": "string", "due_date": "string", "account": "string", "commercial_id": "string", "group_flag": "string",
            "main_flag": "string", "source": "string"}


@register("table_profile", W + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, """
    + (f"min(CASE WHEN CAST({c} AS VARCHAR) <> '' THEN CAST({c} AS VARCHAR) END)" if t == "string" else "CAST(NULL AS VARCHAR)")
    + " AS sample FROM base" for c, t in _PROFILE.items()))
def table_profile(spark, sf):
    p = S.table_profile(T.base(spark, sf))
    # numbers print differently in the two engines: their samples are left out of the comparison
    return p.withColumn("sample", F.when(F.col("dtype") == "string", F.col("sample")))


@register("head_rows", f"""{W} SELECT row_id, uc, period, client FROM base ORDER BY row_id LIMIT 20""")
def head_rows(spark, sf):
    """The first rows of a table in its row order (inspection sample;
    the limit is the feature -- a top-n, evaluated as TakeOrdered)."""
    return T.base(spark, sf).orderBy("row_id").limit(20).select("row_id", "uc", "period", "client")
