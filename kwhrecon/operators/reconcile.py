"""Consolidation of the monthly base with issued charges (T1 building blocks).

Operators: charge keys (F11/F12/F6), cancelled filter (P6), charge dedupe
(D1-D3), primary and fallback joins (J1-J3), append of charges without a
base row (J4, U1, U5), identity backfill (J5), status precedence (V4),
membership and gap typing (J9, C5) and the expansion guard (A11, A12).

Scale notes
-----------
* Dedupe limits every task to one charge per (unit, month) before the
  shuffle, which collapses a hot key; its counts are a hash aggregate of
  the keys (``operators.late``).
* The deduped charges are one row per (uc_key, period_month); each join
  shuffles that small table, so both of its sides can be split by AQE.
* The identity lookup deals the rows of hot keys over salts (``operators.skew``).
* Null join keys are never shuffled together: rows that need no fallback
  get a unique key that cannot match (digits-only keys never contain '#').
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.dates import parse_full_date, period_month
from kwhrecon.functions.keys import account_text, doc_digits, identity_key, portal_uc, uc_key
from kwhrecon.functions.money import charge_money
from kwhrecon.functions.text import is_blank, lower_strip
from kwhrecon.operators.late import ROW, best_rows
from kwhrecon.operators.skew import hot_keys, salted_join

KEYS = ["uc_key", "period_month"]
ORDER = ["src", "row_id"]
# Charge fields carried onto base rows; the fallback join fills them.
CHARGE_FIELDS = ["due_date", "charge_status", "charged_amount", "base_calc",
                 "account", "paid_date", "is_dup", "portal_uc"]
# Columns that are read out of a charge's own, apart from its keys.
CHARGE_VALUES = ["portal_uc", "charged_amount", "base_calc", "charge_status"]
IDENTITY_COLS = ["client", "doc", "distributor", "unit_id"]
IDENTITY_KEY_COLS = ["portal_uc", "alt_uc", "uc"]
GAP_ABSENT = "UC_AUSENTE_NA_GESTAO"
GAP_PERIOD = "PERIODO_NAO_LANCADO"


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def charge_match_keys(charges: DataFrame, uc: str = "uc", period: str = "period") -> DataFrame:
    """The keys of ``charge_keys`` alone: ``uc_key`` and ``period_month``."""
    month = period_month(period) if period in charges.columns else F.lit(None).cast("date")
    return charges.withColumns({"uc_key": uc_key(uc), "period_month": month})


def charge_values(charges: DataFrame, uc: str = "uc", strict_br: bool = False) -> DataFrame:
    """The other columns of ``charge_keys``, ``CHARGE_VALUES``."""
    out = charges.withColumn("portal_uc", portal_uc(uc))
    for money_col in ("charged_amount", "base_calc"):
        if money_col in out.columns:
            dt = charges.schema[money_col].dataType
            out = out.withColumn(money_col, charge_money(money_col, strict_br=strict_br, dtype=dt))
    if "status" in out.columns:
        out = out.withColumnRenamed("status", "charge_status")
    return out


def charge_keys(charges: DataFrame, uc: str = "uc", period: str = "period",
                strict_br: bool = False) -> DataFrame:
    """Keys and typed money on the charge table: ``uc_key``, ``portal_uc``,
    ``period_month``, ``charged_amount``/``base_calc`` as decimals, and the
    charge status renamed to ``charge_status``."""
    month = period_month(period) if period in charges.columns else F.lit(None).cast("date")
    keyed = charges.withColumns({"uc_key": uc_key(uc), "portal_uc": portal_uc(uc), "period_month": month})
    return charge_values(keyed, uc, strict_br)


def drop_cancelled(charges: DataFrame, col: str = "cancelled") -> DataFrame:
    """Drop charges flagged ``sim`` (stripped, any case); null is kept."""
    if col not in charges.columns:
        return charges
    return charges.filter(active_charge(col))


def dedupe_charges(charges: DataFrame, keys=KEYS, due_col: str = "due_date",
                   order_cols=("charge_id",), active: Column | None = None) -> DataFrame:
    """D1+D3: one charge per (unit key, month) -- the latest due date wins,
    nulls last, ties broken by ``order_cols``; ``is_dup`` marks keys that
    had more than one charge and ``dup_count`` counts them.

    With ``active`` (e.g. "not cancelled") every charge is aggregated but
    only active ones compete and count: keys whose charges are all inactive
    keep ``dup_count = 0`` and a null payload, so the same aggregate also
    serves the membership set of all charge units (J9). Rows with a null
    key stay as their own group; ``deduped_view`` drops them (P8).

    The first charge of a key is found before any shuffle of rows and again after
    it (``operators.late``); ``charge_no`` is a unique long of the result.
    """
    keys = list(keys)
    days = F.unix_date(parse_full_date(due_col)) if due_col in charges.columns else F.lit(None).cast("int")
    out = best_rows(charges.withColumn("_before_due", F.coalesce(-days, F.lit(2**31 - 1))), keys,
                    [F.col("_before_due"), *[F.col(c) for c in order_cols]], competes=active, count="dup_count")
    kept = [c for c in out.columns if c not in ("_before_due", "dup_count")]
    out = out.select(*kept, F.monotonically_increasing_id().alias("charge_no"), (F.col("dup_count") > 1).alias("is_dup"), "dup_count")
    return out if active is not None else deduped_view(out, keys)


def deduped_view(agg: DataFrame, keys=KEYS) -> DataFrame:
    """Deduped charges out of ``dedupe_charges``: keys not null, at least one
    active charge (P8 + P6)."""
    cond = F.col("dup_count") > 0
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return agg.filter(cond)


def active_charge(col: str = "cancelled") -> Column:
    """P6 as a predicate: not flagged ``sim`` (null counts as active)."""
    return F.coalesce(lower_strip(col) != "sim", F.lit(True))


def duplicate_stats(charges: DataFrame, keys=KEYS) -> DataFrame:
    """Keys with duplicates and the number of surplus rows (one row)."""
    per_key = charges.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"),
    )


def base_keys(base: DataFrame, uc: str = "uc", period: str = "period", alt: str = "alt_uc") -> DataFrame:
    cols = {"uc_key": uc_key(uc), "period_month": period_month(period), "src": F.lit(0)}
    if alt in base.columns:
        cols["alt_key"] = uc_key(alt)
    return base.withColumns(cols)


def _charge_side(deduped: DataFrame) -> DataFrame:
    """Charge fields for the joins; identity columns stay on the base side."""
    return deduped.select(*_present(deduped, KEYS), *_present(deduped, CHARGE_FIELDS))


def primary_join(base_k: DataFrame, deduped: DataFrame, by_month: bool = True) -> DataFrame:
    """J1 (``by_month``) / J2: left join of the base on (unit key[, month]).
    The right side is unique per key, so the base row count is kept. Base
    copies of charge fields are dropped first (the charge wins)."""
    right = _charge_side(deduped)
    left = base_k.drop(*[c for c in CHARGE_FIELDS if c in base_k.columns])
    if by_month:
        # rows without a valid month cannot match; a unique probe key keeps
        # them from hashing into one reducer (charge keys are digits only)
        probe = F.when(F.col("period_month").isNotNull(), F.col("uc_key")).otherwise(
            F.concat(F.lit("#"), F.col("src").cast("string"), F.lit(":"), F.col("row_id").cast("string")))
        left = left.withColumn("_probe", probe)
        r = right.withColumnRenamed("uc_key", "_probe").withColumnRenamed("period_month", "_r_month")
        out = left.join(r, (left["_probe"] == r["_probe"]) & (left["period_month"] == r["_r_month"]), "left")
        return out.drop(r["_probe"]).drop(left["_probe"]).drop("_r_month")
    right = right.drop("period_month") if "period_month" in right.columns else right
    return left.join(right, ["uc_key"], "left")


def _unfilled(joined: DataFrame) -> Column | None:
    """Without a positive charged value, or without a due date when there is no value column."""
    if "charged_amount" in joined.columns:
        return F.col("charged_amount").isNull() | (F.col("charged_amount") <= 0)
    return F.col("due_date").isNull() if "due_date" in joined.columns else None


def fallback_split(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J3 without its join: the rows that have an alternative key to try, and all others as ``fallback_join`` leaves them."""
    missing = _unfilled(joined) if "alt_key" in joined.columns else None
    if missing is None:
        return joined.limit(0), joined
    asks = F.coalesce(missing & (F.col("alt_key") != "") & F.col("period_month").isNotNull(), F.lit(False))
    rest = joined.where(~asks)
    if "charged_amount" in joined.columns:
        rest = rest.withColumn("charged_amount", F.when(F.col("charged_amount") > 0, F.col("charged_amount")))
    return joined.where(asks), rest


def fallback_join(joined: DataFrame, deduped: DataFrame) -> DataFrame:
    """Rows without a positive charged value (or without a due date when
    there is no value column) try the alternative unit key; fields are filled
    only where still null -- the value also where it is <= 0, even by null."""
    missing = _unfilled(joined) if "alt_key" in joined.columns else None
    if missing is None:
        return joined
    fields = [c for c in CHARGE_FIELDS if c in joined.columns and c in deduped.columns]
    alt = F.when(missing & (F.col("alt_key") != ""), F.col("alt_key"))
    salted = F.coalesce(alt, F.concat(F.lit("#"), F.col("src").cast("string"), F.lit(":"),
                                      F.col("row_id").cast("string")))
    left = joined.withColumns({"_missing": missing, "_alt_join": salted})
    right = _charge_side(deduped).select(
        F.col("uc_key").alias("_alt_join"), F.col("period_month").alias("_alt_month"),
        *[F.col(c).alias("_alt_" + c) for c in fields])
    out = left.join(right, (left["_alt_join"] == right["_alt_join"]) &
                    (left["period_month"] == right["_alt_month"]), "left")
    fills = {}
    for c in fields:
        cur, inc = F.col(c), F.col("_alt_" + c)
        if c == "charged_amount":
            fills[c] = F.when(F.col("_missing") & (cur.isNull() | (cur <= 0)), inc).otherwise(cur)
        else:
            fills[c] = F.when(F.col("_missing"), F.coalesce(cur, inc)).otherwise(cur)
    out = out.withColumns(fills)
    return out.drop(left["_alt_join"]).drop(right["_alt_join"]).drop(
        "_missing", "_alt_month", *["_alt_" + c for c in fields])


def base_match_keys(base_k: DataFrame) -> DataFrame:
    """(key, month) pairs of the base through ``uc`` and ``alt_uc``; blanks dropped."""
    parts = [base_k.select(F.col("uc_key").alias("key"), "period_month")]
    if "alt_key" in base_k.columns:
        parts.append(base_k.select(F.col("alt_key").alias("key"), "period_month"))
    keys = reduce(DataFrame.unionByName, parts)
    return keys.filter((F.col("key") != "") & F.col("period_month").isNotNull())


def portal_only_charges(deduped: DataFrame, base_k: DataFrame, doc: str = "doc", key_as: str | None = None) -> DataFrame:
    """Deduped charges of a document present in the base whose (unit,
    month) matches no base row through either key, shaped as base rows.
    ``key_as`` names a column for the unit key of the charge."""
    if doc not in deduped.columns or doc not in base_k.columns:
        return None
    docs = base_k.select(doc_digits(doc).alias("_doc_key")).filter(F.col("_doc_key") != "").distinct()
    keys = base_match_keys(base_k).distinct()
    ch = deduped.withColumn("_doc_key", doc_digits(doc)).filter(F.col("_doc_key") != "")
    # most charges meet a base row, so few are left to look their document up
    ch = ch.join(keys, (ch["uc_key"] == keys["key"]) & (ch["period_month"] == keys["period_month"]),
                 "left_anti")
    ch = ch.join(docs, "_doc_key", "left_semi")
    null_s = F.lit(None).cast("string")
    key = F.col("uc_key")
    cols = {
        "src": F.lit(1),
        "row_id": F.col("charge_id") if "charge_id" in ch.columns else F.xxhash64(*deduped.columns),
        **({ROW: F.col("charge_no") + F.lit(2**62)} if "charge_no" in ch.columns else {}),
        "uc": F.col("portal_uc"),
        "portal_uc": F.col("portal_uc"),
        "alt_uc": null_s,
        "period": F.date_format("period_month", "yyyy-MM-dd"),
        "period_month": F.col("period_month"),
        "doc": F.col(doc),
        "client": F.col("client") if "client" in ch.columns else null_s,
        "distributor": F.col("distributor") if "distributor" in ch.columns else null_s,
        "source": F.lit("Fatura"),
        "main_flag": F.lit("Y"),
        "amount": F.col("charged_amount").cast("double"),
        "uc_key": null_s,
    }
    for c in CHARGE_FIELDS:
        if c in ch.columns and c not in cols and c != "is_dup":
            cols[c] = F.col(c)
    if key_as:
        cols[key_as] = key
    return ch.select(*[v.alias(k) for k, v in cols.items()])


def append_portal_only(joined: DataFrame, deduped: DataFrame, base_k: DataFrame) -> DataFrame:
    """J4 + U1: append the portal-only charges; missing columns become null."""
    extra = portal_only_charges(deduped, base_k)
    if extra is None:
        return joined
    return joined.unionByName(extra, allowMissingColumns=True)


def identity_backfill(df: DataFrame, identity_cols=IDENTITY_COLS, key_cols=IDENTITY_KEY_COLS,
                      order_cols=ORDER) -> DataFrame:
    """A blank identity value (client, document, distributor, unit id) is
    filled with the first non-blank value seen -- in ``order_cols`` order --
    for any of the row's keys (portal unit, alternative unit, unit; one key
    space, F15-normalised), trying the row's keys in that order.

    Plan: explode <= 3 different keys per row, ``groupBy(key)`` with the least row (partial
    aggregation), then only rows with a blank value look their keys up, in a
    join that deals hot keys over salts.
    """
    idc = _present(df, identity_cols)
    kc = _present(df, key_cols)
    if not idc or not kc:
        return df
    lookup = identity_lookup(df, idc, kc, order_cols)
    needs = reduce(lambda a, b: a | b, [is_blank(c) for c in idc])
    return df.filter(~needs).unionByName(identity_fill(df.filter(needs), lookup, idc, kc, order_cols))


def identity_keys(key_cols) -> Column:
    return F.array(*[identity_key(k) for k in key_cols])


def identity_lookup(df: DataFrame, identity_cols, key_cols, order_cols=ORDER) -> DataFrame:
    """J5, donors: per identity key the first non-blank value of each identity column (``_lk_<column>``)."""
    filled = reduce(lambda a, b: a | b, [~is_blank(c) for c in identity_cols])
    donors = df.where(filled).select(*order_cols, *identity_cols, F.explode(F.array_distinct(identity_keys(key_cols))).alias("_key"))
    return first_donors(donors.filter(F.col("_key") != ""), identity_cols, order_cols)


def first_donors(donors: DataFrame, identity_cols, order_cols=ORDER) -> DataFrame:
    """The lookup rows of exploded donors (order, identity columns, ``_key``).

    Most donors have all values: their first one carries its order once for all columns.
    The others compete by column, and the earlier of both gives the value.
    """
    rows = donors.select("_key", *order_cols, *[F.when(~is_blank(c), F.col(c)).alias(c) for c in identity_cols])
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in identity_cols])
    first = rows.groupBy("_key").agg(
        F.min(F.when(whole, F.struct(*order_cols, *identity_cols))).alias("_whole"),
        *[F.min(F.when(~whole & F.col(c).isNotNull(), F.struct(*order_cols, c))).alias("_part_" + c) for c in identity_cols])

    def value(c: str) -> Column:
        full = F.when(F.col("_whole").isNotNull(), F.struct(*[F.col("_whole")[o].alias(o) for o in [*order_cols, c]]))
        return F.least(full, F.col("_part_" + c))[c]

    return first.select("_key", *[value(c).alias("_lk_" + c) for c in identity_cols])


def identity_fill(target: DataFrame, lookup: DataFrame, identity_cols, key_cols, order_cols=ORDER) -> DataFrame:
    """J5, receivers: blank identity values filled through the row's keys, in their order; a hot key is dealt over salts."""
    ids = [ROW] if ROW in target.columns else list(order_cols)
    probes = (target.select(*ids, F.posexplode(F.array_distinct(identity_keys(key_cols))).alias("_kpos", "_key"))
              .filter(F.col("_key") != ""))
    met = salted_join(probes, lookup, ["_key"], hot_keys(probes, ["_key"]), spread=ids)
    hits = met.groupBy(*ids).agg(*[
        F.min_by(F.col("_lk_" + c), F.when(F.col("_lk_" + c).isNotNull(), F.col("_kpos"))).alias("_fill_" + c)
        for c in identity_cols])
    filled = target.join(hits, ids, "left").withColumns({
        c: F.when(is_blank(c) & F.col("_fill_" + c).isNotNull(), F.col("_fill_" + c)).otherwise(F.col(c))
        for c in identity_cols}).drop(*["_fill_" + c for c in identity_cols])
    return filled.select(*target.columns)


def finalize_columns(df: DataFrame) -> DataFrame:
    """V4 + F17: charge status wins over the base status; account as text."""
    out = df
    if "charge_status" in out.columns:
        if "status" in out.columns:
            out = out.withColumn("status", F.coalesce("charge_status", "status")).drop("charge_status")
        else:
            out = out.withColumnRenamed("charge_status", "status")
    if "account" in out.columns:
        out = out.withColumn("account", account_text("account"))
    return out


def gap_rows(consolidated: DataFrame, unit_keys: DataFrame) -> DataFrame:
    """Rows without a due date, typed: unit in no charge at all, or
    only the month is missing."""
    gaps = consolidated.filter(F.col("due_date").isNull())
    # appended rows have no unit key: they never match, so they skip the join
    keyed = gaps.filter(F.col("uc_key").isNotNull()).join(unit_keys, "uc_key", "left")
    gaps = keyed.unionByName(gaps.filter(F.col("uc_key").isNull()).withColumn("_in_charges", F.lit(None).cast("boolean")))
    return gaps.withColumn(
        "gap_type", F.when(F.col("_in_charges").isNull(), F.lit(GAP_ABSENT)).otherwise(F.lit(GAP_PERIOD))
    ).drop("_in_charges")


def expansion_stats(base: DataFrame, consolidated: DataFrame) -> DataFrame:
    """A11/A12 as one row: base rows, consolidated rows, rows without a due
    date, extra rows and whether the 2x expansion guard holds. One aggregate
    over the union of both (narrow) inputs, no join."""
    both = base.select(F.lit(True).alias("_is_base"), F.lit(False).alias("_no_due")).unionByName(
        consolidated.select(F.lit(False).alias("_is_base"), F.col("due_date").isNull().alias("_no_due")))
    agg = both.agg(F.count_if("_is_base").alias("base_rows"),
                   F.count_if(~F.col("_is_base")).alias("rows"),
                   F.count_if(~F.col("_is_base") & F.col("_no_due")).alias("rows_without_due"))
    return agg.select(
        "base_rows", "rows", "rows_without_due",
        (F.col("rows") - F.col("base_rows")).alias("extra_rows"),
        (~((F.col("rows") > 2 * F.col("base_rows")) & (F.col("base_rows") > 0))).alias("guard_ok"),
    )


def check_expansion(base: DataFrame, consolidated: DataFrame) -> dict:
    """A11 as a decision: raise when the consolidated table more than doubles
    the base (one single-row action)."""
    row = expansion_stats(base, consolidated).first().asDict()
    if not row["guard_ok"]:
        raise ValueError(f"merge aborted: row expansion {row['rows']} vs {row['base_rows']}")
    return row
