"""Consolidate the monthly base with the issued charges.

keys (F11-F14, F6) -> cancelled filter (P6) -> money (F9) -> dedupe
(P8, D1, D3) -> primary join (J1/J2) -> fallback join (J3) -> append
portal-only charges (J4, U1) -> identity backfill (J5) -> status and
account (V4, F17). Gap typing (J9, C5) and the expansion guard (A11) read
the result; ``write_consolidated`` stores it partitioned by month (K1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhrecon.operators import reconcile as R
from kwhrecon.operators.late import ROW
from kwhrecon.session import STORED, materialize
from kwhrecon.sources import folders


@dataclass
class Consolidation:
    consolidated: DataFrame
    gaps: DataFrame
    charges_keyed: DataFrame
    deduped: DataFrame
    unit_keys: DataFrame | None = None
    months: DataFrame | None = None


@dataclass
class Charges:
    """The keyed charges, one row per key (``per_key``), those that compete (``deduped``) and all units."""
    keyed: DataFrame
    per_key: DataFrame
    deduped: DataFrame
    unit_keys: DataFrame


def aggregate_charges(charges: DataFrame, *, strict_br: bool = False, charge_order=("charge_id",),
                      by_month: bool | None = None, checkpoint: bool = True) -> Charges:
    """The per-key charge aggregate (P6, P8, D1-D3), stored with ``checkpoint``.

    Amounts and portal units are read out of the winners alone: the dedupe needs only
    keys, due dates and the order. Without charge ids all columns make the id of an
    appended row, and an order may name a read column; those are read before.
    """
    if by_month is None:
        by_month = "period" in charges.columns
    ch_all = R.charge_keys(charges, strict_br=strict_br)
    late = "charge_id" in charges.columns and not set(charge_order) & set(R.CHARGE_VALUES)
    rows = R.charge_match_keys(charges) if late else ch_all
    if not by_month:
        ch_all, rows = [df.withColumn("period_month", F.lit(None).cast("date")) for df in (ch_all, rows)]
    keys = R.KEYS if by_month else ["uc_key"]
    active = R.active_charge() if "cancelled" in rows.columns else F.lit(True)
    wanted = {*keys, *R.CHARGE_FIELDS, *R.IDENTITY_COLS, *charge_order, "charge_id", "cancelled"}
    known = [c for c in ch_all.columns if c in wanted or "charge_id" not in ch_all.columns]  # without ids, all columns make one
    raw = [c for c in rows.columns if c in {*wanted, "uc", "status"}] if late else known
    per_key = R.dedupe_charges(rows.select(*raw), keys=keys, order_cols=charge_order, active=active)
    if late:
        per_key = R.charge_values(per_key, strict_br=strict_br).select(*known, "charge_no", "is_dup", "dup_count")
    per_key = materialize(per_key) if checkpoint else per_key.drop("charge_no")
    return Charges(ch_all, per_key, R.deduped_view(per_key, keys),
                   per_key.select("uc_key").distinct().withColumn("_in_charges", F.lit(True)))


def consolidate(base: DataFrame, charges: DataFrame | None, *, strict_br: bool = False,
                charge_order=("charge_id",), by_month: bool | None = None,
                checkpoint: bool = True, known: Charges | None = None) -> Consolidation:
    """Build the consolidated table.

    Charges without a month column join by unit alone (J2); ``by_month``
    overrides that choice. ``known`` is their aggregate, if it is there already.

    ``checkpoint`` writes three intermediate tables to the shared folder: the
    per-key charge aggregate (read by both joins, the append and the membership
    test), the base with its primary charges (read by the fallback, the document
    set, the match keys and the backfill), and the few rows that come after it: those
    that tried their alternative key and the appended charges. These are
    eager jobs; all cut the lineage, so a lost executor recomputes from them, not
    from the scan. The joins by month shuffle both sides, so AQE can split a hot
    key; the identity lookup deals hot keys over salts.
    """
    if by_month is None:
        by_month = charges is None or "period" in charges.columns
    base_k = R.base_keys(base)
    if charges is None:
        cons = base_k.withColumn("due_date", F.lit(None).cast("string"))
        empty = cons.limit(0)
        return Consolidation(cons, empty, empty, empty)
    known = known or aggregate_charges(charges, strict_br=strict_br, charge_order=charge_order, by_month=by_month, checkpoint=checkpoint)
    deduped = known.deduped
    joined = R.primary_join(base_k, deduped, by_month=by_month)
    if checkpoint:
        joined = materialize(joined.withColumn(ROW, F.monotonically_increasing_id()))
    if by_month:
        # all base rows keep their keys in the join; only those that ask again meet the charges again
        asking, rest = R.fallback_split(joined)
        late = R.append_portal_only(R.fallback_join(asking, deduped), deduped, joined)
        if checkpoint:
            late = materialize(late)
        joined = rest.unionByName(late, allowMissingColumns=True)
    months = joined.select("period_month")
    joined = R.identity_backfill(joined)
    cons = R.finalize_columns(joined)
    gaps = R.gap_rows(cons, known.unit_keys)
    return Consolidation(cons, gaps, known.keyed, deduped, known.unit_keys, months)


def gap_report_items(gaps: DataFrame) -> DataFrame:
    """K2 items: unit, month text, client, document and gap type, by type and month."""
    return gaps.orderBy("gap_type", F.col("period").cast("string"), "src", "row_id").select(
        F.col("uc").cast("string").alias("no_uc"),
        F.col("period").cast("string").alias("referencia"),
        F.col("client").alias("razao_social"),
        F.col("doc").alias("cpf_cnpj"),
        F.col("gap_type").alias("tipo"),
    )


def gap_report_header(gaps: DataFrame, generated_at: str) -> DataFrame:
    """K2 header: one row with the timestamp and the total."""
    return gaps.agg(F.count(F.lit(1)).alias("total_ucs_sem_vencimento")) \
        .withColumn("gerado_em", F.lit(generated_at))


def write_consolidated(df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None,
                       months: DataFrame | None = None) -> None:
    """K1: Parquet partitioned by billing month.

    The tasks share the rows evenly in the order of the months: a month holding a
    third of all rows is split over many tasks (by its row ids, so rows without a
    unit key spread too), small months share one, so files stay few and large. The
    places come from the number of rows of each month, which ``months`` (any table with
    the same months, by default ``df``) gives without computing the rows twice, as
    the sample of a range partitioning would. Rows are sorted by unit key inside files
    (readers of one unit touch few row groups). An overwrite is written beside
    the table and takes its place when finished, so a stopped run leaves the
    old table."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = folders.staging(path) if mode == "overwrite" else path
    task = folders.month_task(df, n, (df if months is None else months).groupBy("period_month").count().collect())
    (df.repartitionById(n, task)
       .sortWithinPartitions("period_month", "uc_key")
       .write.mode(mode).option("compression", STORED).partitionBy("period_month").parquet(target))
    if target != path:
        folders.publish(df.sparkSession, target, path)
