"""Billing tables derived from the driver's TPC-H-like parquet tables.

``base`` (one row per order: the monthly consumption base), ``charges``
(one row per line item: issued charges), ``metadata`` (enrichment rows) and
``client_groups`` are plain SQL over the input tables, so their size grows
with the input and the very same text runs in Spark and in DuckDB
(the oracle). Placeholders ``{orders}`` etc. are bound to DataFrames in
Spark and to view names in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_SQL = """
SELECT lpad(cast(o_orderkey AS string), 15, '0') AS row_id,
  'ID-' || lpad(cast(o_orderkey AS string), 9, '0') AS unit_id,
  CASE WHEN o_orderkey % 6 = 1 THEN 'T' || cast(o_orderkey + 50000000 AS string)
       WHEN o_orderkey % 4 = 0 THEN '00' || cast(o_orderkey + 1 AS string)
       WHEN o_orderkey % 4 = 1 THEN cast(o_orderkey + 1 AS string) || '.0'
       WHEN o_orderkey % 4 = 2 THEN 'W' || cast(o_orderkey + 1 AS string)
       ELSE cast(o_orderkey + 1 AS string) END AS uc,
  CASE WHEN o_orderkey % 6 = 0 THEN 'D' || cast(cast(floor(o_orderkey / 12) AS bigint) AS string)
       WHEN o_orderkey % 6 = 1 THEN cast(o_orderkey + 1 AS string) || '.0' END AS alt_uc,
  CASE o_orderkey % 5
       WHEN 0 THEN cast(year(o_orderdate) AS string) || '-' || lpad(cast(month(o_orderdate) AS string), 2, '0') || '-' || lpad(cast(day(o_orderdate) AS string), 2, '0')
       WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) * 3 - 2 AS int), 3) || '-' || cast(year(o_orderdate) AS string)
                        ELSE lpad(cast(month(o_orderdate) AS string), 2, '0') || '/' || cast(year(o_orderdate) AS string) END
       WHEN 2 THEN lpad(cast(day(o_orderdate) AS string), 2, '0') || '/' || lpad(cast(month(o_orderdate) AS string), 2, '0') || '/' || cast(year(o_orderdate) AS string)
       WHEN 3 THEN CASE o_orderkey % 3 WHEN 0 THEN cast(day(o_orderdate) AS string) || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) * 3 - 2 AS int), 3) || ' ' || cast(year(o_orderdate) AS string)
                   ELSE cast(year(o_orderdate) AS string) || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '-' END || lpad(cast(month(o_orderdate) AS string), 2, '0') END
       ELSE CASE WHEN o_orderkey % 35 = 4 THEN 'N/A'
                 ELSE lpad(cast(month(o_orderdate) AS string), 2, '0') || '-' || cast(year(o_orderdate) AS string) END
  END AS period,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderkey % 2 = 0 THEN lpad(cast(o_custkey AS string), 14, '0')
       ELSE '00.000.' || lpad(cast(o_custkey AS string), 9, '0') END AS doc,
  CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN c_name || ' LTDA' ELSE c_name END AS client,
  n_name AS distributor,
  o_totalprice AS amount,
  CASE WHEN o_orderkey % 11 = 0 THEN '-'
       ELSE CASE WHEN cents >= 100000 THEN cast(cast(floor(cents / 100000) AS bigint) AS string) || '.' || lpad(cast(cast(floor(cents / 100) AS bigint) % 1000 AS string), 3, '0')
                 ELSE cast(cast(floor(cents / 100) AS bigint) AS string) END || ',' || lpad(cast(cents % 100 AS string), 2, '0') END AS savings,
  CASE WHEN o_orderkey % 20 = 0 THEN '-' ELSE '' END || cast(o_orderkey % 2 AS string) || ',' || lpad(cast(o_orderkey * 7919 % 1000000 AS string), 6, '0') AS tariff,
  CASE WHEN o_orderkey % 31 = 0 THEN 'sem dado' ELSE cast(o_orderkey % 9000 AS string) || '.5' END AS consumed_credit,
  o_totalprice * 0.5 AS cost_with_gd,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice * 0.75 END AS cost_without_gd,
  '0.' || lpad(cast(o_orderkey % 40 AS string), 2, '0') AS contract_discount,
  CASE o_orderkey % 4 WHEN 0 THEN 'Pago' WHEN 1 THEN 'Pendente' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(cast(o_orderdate AS date) AS string) END AS due_date,
  cast(o_custkey AS string) || '.0' AS account,
  CASE WHEN o_custkey % 3 <> 0 THEN 'G' || cast(o_custkey % 50 AS string) || '.0' END AS commercial_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Agrupamento' END AS group_flag,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'Y' ELSE 'N' END AS main_flag,
  CASE o_orderstatus WHEN 'F' THEN 'Fatura' WHEN 'P' THEN 'Contrato' END AS source
FROM (SELECT *, cast(round(o_totalprice * 10) AS bigint) AS cents FROM {orders}) o
  JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

CHARGES_SQL = """
SELECT lpad(cast(l_orderkey AS string), 15, '0') || '-' || cast(l_linenumber AS string) || '-' || lpad(cast(l_partkey AS string), 12, '0')
    || '-' || lpad(cast(l_suppkey AS string), 12, '0') AS charge_id,
  CASE WHEN l_linenumber = 7 THEN 'P' || cast(l_orderkey + 90000000 AS string)
       WHEN l_linenumber % 2 = 0 THEN cast(l_orderkey + 1 AS string) || '.0'
       ELSE cast(l_orderkey + 1 AS string) END AS uc,
  lpad(cast(month(o_orderdate) AS string), 2, '0') || '-' || cast(year(o_orderdate) AS string) AS period,
  CASE WHEN l_partkey % 23 = 0 THEN 'N/A'
       WHEN l_linenumber % 3 = 0 THEN cast(l_shipdate AS date) || ''
       ELSE lpad(cast(day(l_shipdate) AS string), 2, '0') || '/' || lpad(cast(month(l_shipdate) AS string), 2, '0') || '/' || cast(year(l_shipdate) AS string) END AS due_date,
  CASE l_returnflag WHEN 'R' THEN 'Pago' WHEN 'A' THEN 'Acordo firmado' ELSE 'Em aberto' END AS status,
  CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 'Sim' ELSE 'Não' END AS cancelled,
  cast(cast(floor(l_extendedprice) AS bigint) AS string) || ',' || lpad(cast(cast(round(l_extendedprice * 100) AS bigint) % 100 AS string), 2, '0') AS charged_amount,
  CASE WHEN l_quantity < 10 THEN NULL ELSE cast(l_suppkey + 1000 AS string) || '.0' END AS account,
  CASE WHEN l_partkey % 29 = 0 THEN '-'
       WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN lpad(cast(day(l_shipdate) AS string), 2, '0') || '/' || lpad(cast(month(l_shipdate) AS string), 2, '0') || '/' || cast(year(l_shipdate) AS string) END AS paid_date,
  lpad(cast(o_custkey AS string), 14, '0') AS doc
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

METADATA_SQL = """
SELECT lpad(cast(o_orderkey AS string), 15, '0') AS seq,
  cast(cast(floor(o_orderkey / 3) AS bigint) * 3 + 1 AS string) AS uc,
  'CC-' || cast(o_custkey AS string) AS cost_center,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS tag
FROM {orders}
"""

# Text months of every client group; the last one matches no row.
GROUP_PERIODS = ["01/1997", "1997-02", "13/1997"]

_GROUP = """SELECT n_nationkey AS group_id,
  CASE WHEN n_nationkey % 5 = 0 THEN 'Grupo_' || cast(n_nationkey AS string) WHEN n_nationkey IN (7, 8) THEN 'Carteira Comum' ELSE n_name END AS group_name,
  c_name AS client FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

# One row per client of a saved group; two groups share a name, and some clients are listed twice.
CLIENT_GROUPS_SQL = f"{_GROUP} UNION ALL {_GROUP} WHERE c_custkey % 7 = 0"

# One row per month of a saved group.
GROUP_PERIODS_SQL = " UNION ALL ".join(
    f"SELECT n_nationkey AS group_id, '{p}' AS period FROM {{nation}}" for p in GROUP_PERIODS)

# Columns of each input table that the derived tables read (pruned scans).
_NEEDED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey"],
    "nation": ["n_nationkey", "n_name"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_returnflag", "l_shipdate"],
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _sql(spark: SparkSession, sf_dir: str, text: str, tables) -> DataFrame:
    frames = {t: read_table(spark, sf_dir, t, _NEEDED[t]) for t in tables}
    return spark.sql(text, **frames)


def base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, BASE_SQL, ["orders", "customer", "nation"])


def charges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHARGES_SQL, ["lineitem", "orders"])


def metadata_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, METADATA_SQL, ["orders"])


def client_groups_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CLIENT_GROUPS_SQL, ["customer", "nation"])


def group_periods_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GROUP_PERIODS_SQL, ["nation"])


def duckdb_ctes() -> str:
    """The derived tables as a DuckDB ``WITH`` prefix (for oracle SQL)."""
    names = {"orders": "orders", "customer": "customer", "nation": "nation", "lineitem": "lineitem"}
    return ("WITH base AS (" + BASE_SQL.format(**names) + "),\n"
            "charges AS (" + CHARGES_SQL.format(**names) + "),\n"
            "metadata AS (" + METADATA_SQL.format(**names) + "),\n"
            "client_groups AS (" + CLIENT_GROUPS_SQL.format(**names) + "),\n"
            "group_periods AS (" + GROUP_PERIODS_SQL.format(**names) + ")")
