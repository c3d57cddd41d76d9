"""DuckDB SQL for the oracle check: the same semantics as the Spark
builders, written as SQL text over the driver tables.

Expression helpers state the rules of ``kwhrecon.functions`` anew, in their own patterns; ``t1_ctes``
and ``report_ctes`` build the consolidation and report as CTE chains.
"""

from __future__ import annotations

from kwhrecon.sources.fixtures import duckdb_ctes

#: Fixed values, stated here on their own: blanks, accents, month names, and the text for what is missing.
WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
ACCENTED, PLAIN = "áàâãäåÁÀÂÃÄÅçÇéèêëÉÈÊËíìîïÍÌÎÏñÑóòôõöÓÒÔÕÖúùûüÚÙÛÜýÿÝ", "aaaaaaAAAAAAcCeeeeEEEEiiiiIIIInNoooooOOOOOuuuuUUUUyyY"
MONTH_ABBR = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
NOT_AVAILABLE = "Não disponível"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def strip(x: str) -> str:
    return f"trim({txt(x)}, {WS})"


def lower_strip(x: str) -> str:
    return f"lower({strip(x)})"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def f1(x: str) -> str:
    """A date cut at its separators: year first, day first (month first if the middle can be no month), names."""
    p = "string_split(replace(replace(regexp_replace(z, '[ T].*$', ''), '/', '-'), '.', '-'), '-')"
    year = f"(CASE WHEN length({p}[3]) = 4 THEN {p}[3] WHEN {p}[3] < '69' THEN '20' || {p}[3] ELSE '19' || {p}[3] END)"
    name = "regexp_extract(z, '([A-Za-z]{3})[A-Za-z]*[-/., ]+[0-9]{4}$', 1)"
    month = f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({name}))"
    body = (f"CASE WHEN regexp_matches(z, '^[0-9]{{8}}$') THEN try_cast(substr(z, 1, 4) || '-' || substr(z, 5, 2) || '-' || substr(z, 7, 2) AS DATE) "
            f"WHEN regexp_matches(z, '^[0-9]{{4}}[-/.][0-9]{{1,2}}$') THEN try_cast({p}[1] || '-' || {p}[2] || '-1' AS DATE) "
            f"WHEN regexp_matches(z, '^[0-9]{{1,2}}[-/.][0-9]{{4}}$') THEN try_cast({p}[2] || '-' || {p}[1] || '-1' AS DATE) "
            f"WHEN regexp_matches(z, '^[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}([ T].*)?$') "
            f"THEN try_cast({p}[1] || '-' || {p}[2] || '-' || {p}[3] AS DATE) "
            f"WHEN regexp_matches(z, '^[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.]([0-9]{{4}}|[0-9]{{2}})([ T].*)?$') "
            f"THEN CASE WHEN CAST({p}[2] AS INTEGER) > 12 THEN try_cast({year} || '-' || {p}[1] || '-' || {p}[2] AS DATE) "
            f"ELSE try_cast({year} || '-' || {p}[2] || '-' || {p}[1] AS DATE) END "
            f"WHEN regexp_matches(z, '^([0-9]{{1,2}}[-/. ]+)?[A-Za-z]{{3,}}[-/., ]+[0-9]{{4}}$') THEN "
            f"try_cast(right(z, 4) || '-' || {month} || '-' || coalesce(nullif(regexp_extract(z, '^[0-9]+'), ''), '1') AS DATE) END")
    return f"list_transform([{strip(x)}], lambda z: {body})[1]"


def f2(x: str) -> str:
    """Month text read directly, else the month of the full date."""
    s = strip(x)
    return (f"(CASE WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}$') THEN substr({s}, 6, 2) || '-' || substr({s}, 1, 4) "
            f"WHEN regexp_matches({s}, '^[0-9]{{2}}[-/][0-9]{{4}}$') THEN substr({s}, 1, 2) || '-' || substr({s}, 4, 4) "
            f"WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') "
            f"THEN lpad(split_part({s}, '-', 2), 2, '0') || '-' || substr({s}, 1, 4) "
            f"ELSE strftime({f1(x)}, '%m-%Y') END)")


def f3(x: str, default: str = NOT_AVAILABLE) -> str:
    return f"coalesce(strftime({f1(x)}, '%d-%m-%Y'), {q(default)})"


def f4(x: str, default: str = NOT_AVAILABLE) -> str:
    return f"coalesce(replace({f2(x)}, '-', '/'), {q(default)})"


def f5(x: str) -> str:
    return f4(x, "")


def f6(x: str) -> str:
    return f"try_cast(regexp_replace({f2(x)}, '^(\\d{{2}})-(\\d{{4}})$', '\\2-\\1-01') AS DATE)"


def dropdot(s: str) -> str:
    return f"(CASE WHEN ends_with({s}, '.0') THEN left({s}, length({s}) - 2) ELSE {s} END)"


def uc_key(x: str) -> str:
    return f"coalesce(ltrim(regexp_replace({dropdot(strip(x))}, '[^0-9]', '', 'g'), '0'), '')"


def portal_uc(x: str) -> str:
    s = dropdot(strip(x))
    return f"(CASE WHEN {x} IS NULL OR lower({s}) IN ('', 'nan', 'none') THEN NULL ELSE {s} END)"


def uc_text(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {x} IS NULL OR lower({s}) IN ('', 'nan', 'none') THEN NULL ELSE {dropdot(s)} END)"


def doc_digits(x: str) -> str:
    return f"coalesce(regexp_replace({txt(x)}, '[^0-9]', '', 'g'), '')"


def identity_key(x: str) -> str:
    return f"coalesce(upper(regexp_replace({dropdot(strip(x))}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '')"


def contains_letter(x: str) -> str:
    return f"coalesce(regexp_matches({txt(x)}, '\\p{{L}}'), false)"


def account_text(x: str) -> str:
    t = txt(x)
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN ends_with({t}, '.0') THEN coalesce("
            f"CAST(CAST(try_cast({t} AS DECIMAL(38,1)) AS DECIMAL(38,0)) AS VARCHAR), left({t}, length({t}) - 2)) "
            f"ELSE {t} END)")


def strip_suffix(x: str, tokens=("nan", "None", "")) -> str:
    s = strip(dropdot(txt(x)))
    toks = ", ".join(q(t) for t in tokens) if tokens else "NULL"
    return f"(CASE WHEN {x} IS NULL OR {s} IN ({toks}) THEN NULL ELSE {s} END)"


def gkt(x: str, fill: str | None = "N/A") -> str:
    v = f"upper({strip(x)})"
    core = f"(CASE WHEN {x} IS NULL OR {v} IN ('NAN', 'NONE', '') THEN NULL ELSE {v} END)"
    return f"coalesce({core}, {q(fill)})" if fill is not None else core


def br(x: str, default=None, numeric: bool = False, kind: str = "24,6") -> str:
    d = "NULL" if default is None else f"CAST({default} AS DECIMAL({kind}))"
    if numeric:
        return f"coalesce(CAST({x} AS DECIMAL(24,6)), {d})"
    raw = txt(x)
    s = strip(x)
    cleaned = f"(CASE WHEN contains({s}, ',') THEN replace(replace({s}, '.', ''), ',', '.') ELSE {s} END)"
    toks = "('', '-', '--', ' - ')"
    val = (f"(CASE WHEN {raw} IS NULL OR {raw} IN {toks} OR {s} IN {toks} THEN NULL "
           f"WHEN regexp_matches({cleaned}, '^[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][-+]?[0-9]+)?$') "
           f"THEN try_cast({cleaned} AS DECIMAL({kind})) END)")
    return f"coalesce({val}, {d})"


def sanitize_filename(x: str, default: str = "arquivo") -> str:
    s = f"regexp_replace(regexp_replace({txt(x)}, '[^a-zA-Z0-9_\\-]', '_', 'g'), '_+', '_', 'g')"
    s = f"regexp_replace({s}, '^_+|_+$', '', 'g')"
    return f"coalesce(nullif({s}, ''), {q(default)})"


def search_norm(x: str) -> str:
    s = f"translate({txt(x)}, {q(ACCENTED)}, {q(PLAIN)})"
    s = f"lower(regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g'))"
    s = f"regexp_replace(regexp_replace({s}, '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"coalesce(regexp_replace({s}, '^ | $', '', 'g'), '')"


def month_abbr(m: str) -> str:
    return "[" + ", ".join(q(a) for a in MONTH_ABBR) + f"][{m}]"


def format_document(x: str) -> str:
    raw = f"regexp_replace({strip(x)}, '[./-]', '', 'g')"
    pad = f"lpad({raw}, 14, '0')"
    cnpj = (f"substr({pad},1,2) || '.' || substr({pad},3,3) || '.' || substr({pad},6,3) || '/' || "
            f"substr({pad},9,4) || '-' || substr({pad},13,2)")
    cpf = f"substr({raw},1,3) || '.' || substr({raw},4,3) || '.' || substr({raw},7,3) || '-' || substr({raw},10,2)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN length({raw}) = 11 THEN {cpf} "
            f"WHEN length({raw}) <= 14 THEN {cnpj} ELSE {txt(x)} END)")


def sheet_title(x: str, default: str = "Consolidado") -> str:
    s = f"substr(regexp_replace({txt(x)}, '[\\\\/?*\\[\\]:]', '', 'g'), 1, 31)"
    return f"coalesce(nullif({s}, ''), {q(default)})"


def classify(x: str = "source") -> str:
    return f"(CASE WHEN coalesce({strip(x)} = 'Fatura', false) THEN 'Fatura' ELSE 'Regra de Negócio' END)"


# ---------------------------------------------------------------- T1 (consolidation)

CHARGE_FIELDS = ["due_date", "charge_status", "charged_amount", "account", "paid_date", "is_dup", "portal_uc"]


def t1_ctes(row_id: str = "row_id", charge_id: str = "charge_id") -> str:
    """Consolidated table as CTEs; final CTE ``consolidated``. The ids may be other expressions."""
    ident = ["client", "doc", "distributor", "unit_id"]
    base_cols = ["row_id", "unit_id", "uc", "alt_uc", "period", "doc", "client", "distributor", "amount",
                 "savings", "tariff", "commercial_id", "group_flag", "main_flag", "source", "status", "consumed_credit",
                 "cost_with_gd", "cost_without_gd", "contract_discount"]
    fills = []
    for c in CHARGE_FIELDS:
        if c == "charged_amount":
            fills.append("CASE WHEN m AND (j.charged_amount IS NULL OR j.charged_amount <= 0) "
                         "THEN a.charged_amount ELSE j.charged_amount END AS charged_amount")
        else:
            fills.append(f"CASE WHEN m THEN coalesce(j.{c}, a.{c}) ELSE j.{c} END AS {c}")
    lk = ",\n    ".join(f"arg_min({c}, struct_pack(s := src, r := row_id, k := kpos)) "
                       f"FILTER (WHERE NOT {blank(c)}) AS {c}" for c in ident)
    fill_cols = ",\n    ".join(
        f"CASE WHEN {blank('u.' + c)} AND coalesce(l0.{c}, l1.{c}, l2.{c}) IS NOT NULL "
        f"THEN coalesce(l0.{c}, l1.{c}, l2.{c}) ELSE u.{c} END AS {c}" for c in ident)
    return f"""{duckdb_ctes()},
charges_k AS (
  SELECT {charge_id} AS charge_id, uc, period, due_date, status AS charge_status, cancelled, account, paid_date, doc,
    {uc_key('uc')} AS uc_key, {portal_uc('uc')} AS portal_uc, {f6('period')} AS period_month,
    {br('charged_amount', kind='18,2')} AS charged_amount,
    coalesce({lower_strip('cancelled')} <> 'sim', true) AS active,
    {f1('due_date')} AS due_d
  FROM charges),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY uc_key, period_month ORDER BY due_d DESC NULLS LAST, charge_id) AS rn,
    count(*) OVER (PARTITION BY uc_key, period_month) AS dup_count
  FROM charges_k WHERE active AND period_month IS NOT NULL),
deduped AS (SELECT * EXCLUDE (rn), dup_count > 1 AS is_dup FROM ranked WHERE rn = 1),
unit_keys AS (SELECT DISTINCT uc_key FROM charges_k),
base_k AS (
  SELECT {row_id} AS row_id, {", ".join(base_cols[1:])}, {uc_key('uc')} AS uc_key, {f6('period')} AS period_month,
    {uc_key('alt_uc')} AS alt_key, 0 AS src FROM base),
j1 AS (
  SELECT b.*, {", ".join('d.' + c for c in CHARGE_FIELDS)},
    (d.charged_amount IS NULL OR d.charged_amount <= 0) AS m
  FROM base_k b LEFT JOIN deduped d ON b.uc_key = d.uc_key AND b.period_month = d.period_month),
j3 AS (
  SELECT j.* EXCLUDE ({", ".join(CHARGE_FIELDS)}, m), {", ".join(fills)}
  FROM j1 j LEFT JOIN deduped a ON j.m AND j.alt_key <> '' AND a.uc_key = j.alt_key
    AND a.period_month = j.period_month),
match_keys AS (
  SELECT uc_key AS key, period_month FROM base_k WHERE uc_key <> '' AND period_month IS NOT NULL
  UNION ALL SELECT alt_key, period_month FROM base_k WHERE alt_key <> '' AND period_month IS NOT NULL),
base_docs AS (SELECT DISTINCT {doc_digits('doc')} AS k FROM base WHERE {doc_digits('doc')} <> ''),
appended AS (
  SELECT 1 AS src, d.charge_id AS row_id, d.portal_uc AS uc, d.portal_uc, CAST(NULL AS VARCHAR) AS alt_uc,
    strftime(d.period_month, '%Y-%m-%d') AS period, d.period_month, d.doc, CAST(NULL AS VARCHAR) AS client,
    CAST(NULL AS VARCHAR) AS distributor, 'Fatura' AS source, 'Y' AS main_flag,
    CAST(d.charged_amount AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS uc_key,
    d.due_date, d.charge_status, d.charged_amount, d.account, d.paid_date
  FROM deduped d
  WHERE {doc_digits('d.doc')} IN (SELECT k FROM base_docs)
    AND NOT EXISTS (SELECT 1 FROM match_keys k WHERE k.key = d.uc_key AND k.period_month = d.period_month)),
unioned AS (SELECT * FROM j3 UNION ALL BY NAME SELECT * FROM appended),
donors AS (
  SELECT {identity_key('portal_uc')} AS key, 0 AS kpos, * FROM unioned
  UNION ALL SELECT {identity_key('alt_uc')}, 1, * FROM unioned
  UNION ALL SELECT {identity_key('uc')}, 2, * FROM unioned),
lookup AS (
  SELECT key,
    {lk}
  FROM donors WHERE key <> '' GROUP BY key),
backfilled AS (
  SELECT u.* EXCLUDE ({", ".join(ident)}),
    {fill_cols}
  FROM unioned u
    LEFT JOIN lookup l0 ON l0.key = {identity_key('u.portal_uc')}
    LEFT JOIN lookup l1 ON l1.key = {identity_key('u.alt_uc')}
    LEFT JOIN lookup l2 ON l2.key = {identity_key('u.uc')}),
consolidated AS (
  SELECT * EXCLUDE (charge_status, status, account), coalesce(charge_status, status) AS status, {account_text('account')} AS account
  FROM backfilled)"""





# ---------------------------------------------------------------- T2-T4 (reports)

def bn(x: str) -> str:
    return f"(CASE WHEN {strip(x)} <> '' THEN {x} END)"


def period_parts(x: str) -> str:
    p = f2(x)
    return (f"(CASE WHEN regexp_matches({p}, '^\\d{{2}}-\\d{{4}}$') AND try_cast(substr({p}, 1, 2) AS INTEGER) "
            f"BETWEEN 1 AND 12 THEN struct_pack(year := try_cast(substr({p}, 4, 4) AS INTEGER), "
            f"month := try_cast(substr({p}, 1, 2) AS INTEGER)) END)")


def periods_suffix(arr: str) -> str:
    parts = f"list_sort(list_distinct(list_filter(list_transform({arr}, lambda p: {period_parts('p')}), lambda x: x IS NOT NULL)))"
    return (f"coalesce(array_to_string(list_transform(list_distinct(list_transform({parts}, lambda x: x.year)), "
            f"lambda y: array_to_string(list_transform(list_filter({parts}, lambda x: x.year = y), lambda x: {month_abbr('x.month')}), '_') "
            f"|| '_' || CAST(y AS VARCHAR)), '_'), '')")


def output_file_name(name: str, n: str, first: str, periods: str) -> str:
    raw = f"coalesce(nullif({txt(name)}, ''), 'Sem_Nome')"
    base = sanitize_filename(f"(CASE WHEN {n} = 1 THEN {first} WHEN {n} > 1 THEN {first} || '_e_outros' ELSE {raw} END)")
    suffix = periods_suffix(periods)
    generic = f"(CASE WHEN {suffix} = '' THEN {base} || '.xlsx' ELSE {base} || '_' || {suffix} || '.xlsx' END)"
    return (f"(CASE WHEN regexp_matches({strip(raw)}, '^Grupo_\\d+$') THEN {generic} "
            f"ELSE {sanitize_filename(raw)} || '.xlsx' END)")


def base_name(name: str, n: str, first: str) -> str:
    """A custom name without the months at its end, else one client or the first of several."""
    safe = sanitize_filename(name, "memoria_calculo")
    cut = f"regexp_replace({safe}, '((_({'|'.join(MONTH_ABBR)}))+_[0-9]{{4}})+$', '', 'i')"
    custom = f"coalesce(nullif(trim({cut}, '_'), ''), {safe})"
    return (f"(CASE WHEN {name} IS NOT NULL AND {name} <> '' AND NOT starts_with({name}, 'Grupo_') THEN {custom} "
            f"WHEN {n} = 1 THEN {sanitize_filename(first, 'memoria_calculo')} WHEN {n} > 1 THEN {sanitize_filename(first + " || '_e_outros'", 'memoria_calculo')} "
            f"ELSE 'Memoria_Calculo' END)")


def zip_entry(name: str, n: str, first: str, period: str) -> str:
    token = (f"(CASE WHEN {period_parts(period)} IS NOT NULL THEN {month_abbr(period_parts(period) + '.month')} || '_' || CAST({period_parts(period)}.year AS VARCHAR) "
             f"ELSE {sanitize_filename('lower(' + txt(period) + ')', 'memoria_calculo')} END)")
    return f"{base_name(name, n, first)} || '_' || {token} || '.xlsx'"


def suggested(name: str, n: str, first: str, months: str) -> str:
    return f"{base_name(name, n, first)} || CASE WHEN {periods_suffix(months)} = '' THEN '' ELSE '_' || {periods_suffix(months)} END"


GROUP_HEADS = """heads AS (SELECT h.group_id, group_name, n, first, months FROM
  (SELECT group_id, min(group_name) AS group_name, count(DISTINCT client) AS n, min(client) AS first FROM client_groups
   WHERE client IS NOT NULL GROUP BY group_id) h
  JOIN (SELECT group_id, list_sort(list(DISTINCT period)) AS months FROM group_periods GROUP BY group_id) p ON h.group_id = p.group_id)"""


REPORT_NAMES = ["unit_id", "period", "uc", "account", "doc", "client", "distributor", "consumed_credit",
                "contract_discount", "due_date", "status", "amount", "tariff", "cost_with_gd", "cost_without_gd",
                "savings", "classification"]
#: Measures, and whether the base has them as numbers.
MEASURES = [("consumed_credit", False), ("amount", True), ("tariff", False), ("cost_with_gd", True), ("cost_without_gd", True), ("savings", False)]


def group_scope_ctes() -> str:
    fname = output_file_name("group_name", "n", "first", "months")
    return f"""{GROUP_HEADS},
grp AS (SELECT group_id, {fname} AS output_name FROM heads),
gmembers AS (SELECT DISTINCT c.group_id, output_name, client FROM client_groups c JOIN grp ON grp.group_id = c.group_id WHERE client IS NOT NULL),
keyed AS (SELECT *, {doc_digits('doc')} AS dk FROM consolidated),
by_client AS (SELECT k.*, m.group_id, m.output_name FROM keyed k JOIN gmembers m ON k.client = m.client),
gdocs AS (SELECT DISTINCT group_id, output_name, dk FROM by_client WHERE dk <> ''),
scope_all AS (SELECT k.*, d.group_id, d.output_name FROM keyed k JOIN gdocs d ON k.dk = d.dk WHERE k.dk <> ''
  UNION ALL BY NAME SELECT * FROM by_client WHERE dk = ''),
gmonths AS (SELECT DISTINCT group_id, {f5('period')} AS m FROM group_periods WHERE {f5('period')} <> ''),
scope_p AS (SELECT s.* FROM scope_all s WHERE {f5('s.period')} <> ''
  AND EXISTS (SELECT 1 FROM gmonths m WHERE m.group_id = s.group_id AND m.m = {f5('s.period')}))"""


def report_ctes(mode: str = "default", include_children: bool = True, sort_by: str = "savings",
                only_pending: bool = False, split_audit: bool = False, multi_sheet: bool = False,
                scope: str = "all", with_meta: bool = True, as_of: str = "1996-06-01",
                incomplete: str = "all", scope_sql: tuple[str, str, str] | None = None, flagged_only: bool = False) -> str:
    """The report as CTEs over ``t1_ctes()``; final CTEs ``grouped`` and ``report``."""
    X = {"all": [], "by_month": ["output_period"], "by_group": ["group_id", "output_name"]}[scope]
    xk = "".join(k + ", " for k in X)
    on_x = "".join(f" AND a.{k} = s.{k}" for k in X if k != "output_period")
    if scope == "by_group":
        scope_ctes = group_scope_ctes() + ",\nscope AS (SELECT * EXCLUDE (dk) FROM scope_p),\n" \
                     "alias_scope AS (SELECT * EXCLUDE (dk) FROM scope_all)"
        ax = "group_id, output_name, "
    elif scope_sql:
        ctes, rows, alias_rows = scope_sql
        scope_ctes, ax = f"{ctes},\nscope AS (SELECT * FROM {rows}),\nalias_scope AS (SELECT * FROM {alias_rows})", ""
    else:
        scope_ctes = "scope AS (SELECT * FROM consolidated),\nalias_scope AS (SELECT * FROM consolidated)"
        ax = ""
    parts = [t1_ctes() + ",", scope_ctes + ","]
    parts.append(f"""alias AS (SELECT {ax}alias_key, arg_min(alias_uc, struct_pack(s := src, r := row_id)) AS alias_uc
  FROM (SELECT {ax}{uc_text('portal_uc')} AS alias_key, uc AS alias_uc, src, row_id FROM alias_scope)
  WHERE alias_key IS NOT NULL AND alias_uc IS NOT NULL AND {contains_letter('alias_uc')} GROUP BY {ax}alias_key),
work AS (SELECT s.*, coalesce({uc_text('s.portal_uc')}, a.alias_uc, {uc_text('s.uc')}) AS uc_final
  FROM scope s LEFT JOIN alias a ON a.alias_key = {uc_text('s.uc')}{on_x}
  WHERE s.charged_amount IS NOT NULL AND CAST(s.charged_amount AS DOUBLE) > 0),
pref AS (SELECT *, NOT coalesce({lower_strip('source')} = 'fatura', false) AS p1,
  NOT (account IS NOT NULL AND {strip('account')} <> '') AS p2, -{br('amount', 0, True)} AS p3
  FROM work WHERE uc_final IS NOT NULL AND period IS NOT NULL),
d4 AS (SELECT *, row_number() OVER (PARTITION BY {ax}uc_final, period ORDER BY p1, p2, p3, src, row_id) AS rn FROM pref),
portal AS (SELECT * EXCLUDE (rn, uc, amount, uc_final), uc_final AS uc,
  coalesce(CAST(charged_amount AS DOUBLE), 0.0) AS amount{', ' + f5('period') + ' AS output_period' if scope == 'by_month' else ''}
  FROM d4 WHERE rn = 1),""")
    if with_meta:
        parts.append("""meta_last AS (SELECT uc AS m_uc, cost_center, tag FROM (SELECT *, row_number() OVER
  (PARTITION BY uc ORDER BY seq DESC) AS rn FROM metadata) WHERE rn = 1),
enriched AS (SELECT p.*, m.cost_center, m.tag FROM portal p LEFT JOIN meta_last m ON p.uc = m.m_uc),""")
    else:
        parts.append("enriched AS (SELECT * FROM portal),")
    inc = {"all": "TRUE",
           "complete_only": f"NOT (due_date IS NULL OR {lower_strip('due_date')} IN ('', 'nan', 'nat', 'none'))",
           "incomplete_only": f"(due_date IS NULL OR {lower_strip('due_date')} IN ('', 'nan', 'nat', 'none'))"}[incomplete]
    if sort_by == "savings":
        kcols, korder = f"-{br('savings', 0)} AS k", "k"
    elif sort_by == "client":
        kcols, korder = "client IS NULL AS kn, client AS k", "kn, k"
    else:
        kcols, korder = "uc IS NULL AS kn, CAST(uc AS VARCHAR) AS k", "kn, k"
    ordc = f"{korder}, p1, p2, p3, src, row_id"
    parts.append(f"ordered AS (SELECT *, {kcols} FROM enriched WHERE {inc}),")
    sums = MEASURES
    parsed = ", ".join(f"CAST({br(c, None, num)} AS DOUBLE) AS {c}" for c, num in sums)
    if mode == "none":
        where = "" if include_children else f"WHERE coalesce(upper({strip('main_flag')}) = 'Y', false)"
        parts.append(f"""grouped AS (SELECT * REPLACE ({parsed}), 'normal' AS row_kind, 1 AS kind_rank,
  {classify()} AS classification FROM ordered {where}),""")
    else:
        if X:
            hc = f"hc AS (SELECT {', '.join(X)}, bool_or({bn('commercial_id')} IS NOT NULL) AS has_ci FROM ordered GROUP BY {', '.join(X)}),"
            hj = "LEFT JOIN hc USING (" + ", ".join(X) + ")"
        else:
            hc = f"hc AS (SELECT count(*) > 0 AS has_ci FROM ordered WHERE {bn('commercial_id')} IS NOT NULL),"
            hj = "LEFT JOIN hc ON TRUE"
        if mode == "distributor":
            keys_sql, keys = f"{gkt('period')} AS g1, {gkt('distributor')} AS g2", ["g1", "g2"]
            alt_sql = ""
        elif mode == "cnpj":
            keys_sql, keys = f"{gkt('period')} AS g1, {gkt('doc')} AS g2", ["g1", "g2"]
            alt_sql = ""
        else:
            third = (f"coalesce(CAST(CASE WHEN has_ci THEN coalesce({bn('commercial_id')}, {bn('alt_uc')}, uc) "
                     f"ELSE coalesce({bn('alt_uc')}, uc) END AS VARCHAR), 'N/A')")
            if flagged_only:  # the columns of commercial ids and alternative units are missing
                third = f"coalesce(CASE WHEN coalesce({strip('group_flag')} = 'Agrupamento', false) THEN 'AGRUPADO' ELSE CAST(uc AS VARCHAR) END, 'N/A')"
            keys_sql = f"{gkt('period')} AS g1, {gkt('client')} AS g2, {third} AS g3"
            keys = ["g1", "g2", "g3"]
            alt_sql = f", CASE WHEN has_ci THEN alt_uc ELSE coalesce({bn('alt_uc')}, uc) END AS alt_uc"
        gk = X + keys
        gks = ", ".join(gk)
        san = ", ".join(f"{strip_suffix(c)} AS {c}" for c in ["uc", "alt_uc", "commercial_id", "account"])
        marked = (f"bool_or(coalesce({strip('group_flag')} = 'Agrupamento', false) OR "
                  f"coalesce(upper({strip('main_flag')}) = 'Y', false))")
        q_expr = "s.n > 1 AND s.marked" if mode == "default" else "s.n > 1"
        label = f"Consolidado ({mode.capitalize()})"
        parent_class = ("CASE WHEN s.n_inv * 2 > s.n THEN 'Fatura' ELSE 'Regra de Negócio' END"
                        if include_children else classify("f.source"))
        child_where = "" if include_children else f"WHERE NOT ({q_expr})"
        parts.append(f"""{hc}
g0 AS (SELECT o.*, coalesce(hc.has_ci, false) AS has_ci FROM ordered o {hj}),
g1s AS (SELECT * EXCLUDE (alt_uc){alt_sql or ', alt_uc'}, {keys_sql} FROM g0),
g AS (SELECT * REPLACE ({san}) FROM g1s),
stats AS (SELECT {gks}, count(*) AS n, {marked} AS marked, count_if({classify()} = 'Fatura') AS n_inv,
  {", ".join(f"CAST(sum({br(c, 0, num)}) AS DOUBLE) AS s_{c}" for c, num in sums)} FROM g GROUP BY {gks}),
firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT g.*, row_number() OVER (PARTITION BY {gks} ORDER BY {ordc}) AS rn FROM g) WHERE rn = 1),
parents AS (SELECT f.* REPLACE ({q(label)} AS uc, {", ".join(f"s.s_{c} AS {c}" for c, _ in sums)}),
  'parent' AS row_kind, 0 AS kind_rank, {parent_class} AS classification
  FROM firsts f JOIN stats s USING ({gks}) WHERE {q_expr}),
members AS (SELECT g.* REPLACE ({parsed}), CASE WHEN {q_expr} THEN 'child' ELSE 'normal' END AS row_kind,
  1 AS kind_rank, {classify('g.source')} AS classification FROM g JOIN stats s USING ({gks}) {child_where}),
separators AS (SELECT {gks}, 'separator' AS row_kind, 2 AS kind_rank, 'Regra de Negócio' AS classification FROM stats),
grouped AS (SELECT * FROM parents UNION ALL BY NAME SELECT * FROM members UNION ALL BY NAME SELECT * FROM separators),""")
    proj = ", ".join(c for c in REPORT_NAMES if c not in ("status", "due_date", "period", "doc", "tariff", "account", "uc", "unit_id"))
    extra = "cost_center, tag, " if with_meta else ""
    pending = f"WHERE coalesce({lower_strip('status')} <> 'pago', true)" if only_pending else ""
    s = "coalesce(lower(trim(status_raw, " + WS + ")), '')"
    neg = f"(contains({s}, 'negociad') OR contains({s}, 'acordo'))"
    paid = f"contains({s}, 'pago')"
    sect = "(CASE WHEN row_kind = 'child' OR classification = 'Regra de Negócio' THEN 'Aud' ELSE 'Fin' END) || ' - '"
    prefix = sect if split_audit else "''"
    if multi_sheet:
        sheet, sheet_where = f"{prefix} || CAST(distributor AS VARCHAR)", "WHERE distributor IS NOT NULL"
    else:
        sheet, sheet_where = f"{prefix} || 'Consolidado'", ""
    parts.append(f"""paid AS (SELECT {xk}{proj}, {extra}row_kind, kind_rank,
  CASE WHEN {neg} THEN 'Negociado' WHEN {paid} THEN 'Pago' WHEN {f1('due_raw')} < DATE '{as_of}' THEN 'Atrasado'
       ELSE 'Em aberto' END AS status,
  CASE WHEN NOT {neg} AND {paid} THEN '' END AS paid_date,
  {f3('due_raw')} AS due_date,
  CASE WHEN period_raw IS NULL THEN NULL ELSE {f4('period_raw')} END AS period,
  {format_document('doc_raw')} AS doc,
  CASE WHEN tariff_raw IS NOT NULL AND tariff_raw < 0 THEN 0.0 ELSE CAST(tariff_raw AS DOUBLE) END AS tariff,
  trim(CAST(account_raw AS VARCHAR)) AS account, trim(CAST(uc_raw AS VARCHAR)) AS uc,
  trim(CAST(unit_id_raw AS VARCHAR)) AS unit_id,
  row_kind = 'parent' AS is_parent, row_kind = 'child' AS is_child, row_kind = 'separator' AS is_separator
  FROM (SELECT *, status AS status_raw, due_date AS due_raw, period AS period_raw, doc AS doc_raw, tariff AS tariff_raw,
        account AS account_raw, uc AS uc_raw, unit_id AS unit_id_raw FROM grouped)),
pending AS (SELECT * REPLACE (trim(period) AS period) FROM paid {pending}),
sheets AS (SELECT *, {sheet_title(sheet)} AS sheet FROM pending {sheet_where}),
report AS (SELECT * REPLACE ({", ".join(f"CASE WHEN row_kind <> 'separator' THEN {c} END AS {c}" for c in REPORT_NAMES)}) FROM sheets)""")
    return "\n".join(parts)
