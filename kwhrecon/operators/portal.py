"""Portal-first restriction of a report scope.

Only charges that exist in the billing portal stay, at most one per
(final unit, month text), with a positive charged value that then becomes
the billed amount. Keys, preference and row numbers of the scope are stored
as a narrow table; the best preference per key is a hash aggregate of one number
over it, and whole rows are fetched for the winners only. The lookups deal hot
keys over salts (``operators.skew``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.keys import contains_letter, uc_text
from kwhrecon.functions.money import br_number
from kwhrecon.functions.text import lower_strip, strip
from kwhrecon.operators.filters import positive_charge
from kwhrecon.operators.late import ROW
from kwhrecon.operators.skew import hot_keys, salted_join
from kwhrecon.session import materialize

ORDER = ["src", "row_id"]


def _ord(order_cols) -> Column:
    return F.struct(*[F.col(c) for c in order_cols])


def _portal_text(df: DataFrame) -> Column:
    if "portal_uc" in df.columns:
        return uc_text("portal_uc")
    if "alt_uc" in df.columns:
        return uc_text("alt_uc")
    return F.lit(None).cast("string")


def alias_map(scope: DataFrame, order_cols=ORDER, extra_keys=()) -> DataFrame:
    """J6 + D6: for each portal unit text, the first unit id (raw text) that
    contains a letter -- an alphanumeric alias of a numeric portal id.
    One ``groupBy`` with ``min_by`` (partial aggregation)."""
    src = scope.select(*extra_keys, _portal_text(scope).alias("alias_key"), F.col("uc").alias("alias_uc"),
                       _ord(order_cols).alias("_ord"))
    src = src.filter(F.col("alias_key").isNotNull() & F.col("alias_uc").isNotNull()
                     & contains_letter("alias_uc"))
    return src.groupBy(*extra_keys, "alias_key").agg(F.min_by("alias_uc", "_ord").alias("alias_uc"))


def final_unit(df: DataFrame, aliases: DataFrame, order_cols=ORDER, extra_keys=()) -> DataFrame:
    """Final unit = portal unit, else the alias of the row's unit, else
    the unit itself (F13 texts). Rows with a null unit text get a unique
    probe key so they do not pile up in one join partition."""
    base = uc_text("uc")
    salt = F.concat(F.lit("\u0001"), *[F.col(c).cast("string") for c in order_cols])
    keyed = df.withColumns({"_uc_base": base, "_uc_portal": _portal_text(df)})
    keyed = keyed.withColumn("_probe", F.coalesce(F.col("_uc_base"), salt))
    on = [*extra_keys, "_probe"]
    joined = salted_join(keyed, aliases.withColumnRenamed("alias_key", "_probe"), on, hot_keys(keyed, on), "left", order_cols)
    return joined.withColumn("uc_final", F.coalesce("_uc_portal", "alias_uc", "_uc_base")) \
        .drop("_probe", "alias_uc", "_uc_portal", "_uc_base")


def preference_order(df: DataFrame, order_cols=ORDER) -> Column:
    """D4 ordering (ascending): source ``fatura`` first, then a filled
    account, then the larger billed value (F8, bad -> 0), then row order."""
    pref_invoice = (lower_strip("source") == "fatura") if "source" in df.columns else F.lit(False)
    pref_invoice = F.coalesce(pref_invoice, F.lit(False))
    pref_account = (F.col("account").isNotNull() & (strip("account") != "")) if "account" in df.columns \
        else F.lit(False)
    amount_t = df.schema["amount"].dataType if "amount" in df.columns else None
    value = br_number("amount", 0, dtype=amount_t) if "amount" in df.columns else F.lit(0).cast("decimal(18,2)")
    return F.struct((~pref_invoice).alias("_p1"), (~pref_account).alias("_p2"), (-value).alias("_p3"),
                    *[F.col(c) for c in order_cols])


def portal_winners(scope: DataFrame, aliases: DataFrame, order_cols=ORDER, period: str = "period", extra_keys=()) -> DataFrame:
    """D9 + D4: (extra keys, row ids, ``uc_final``) of the best row per (final unit, month text) of a filtered scope.

    ``scope`` needs only the columns that decide; it is stored once, narrow.
    """
    extra_keys = list(extra_keys)
    ids = [ROW] if ROW in scope.columns else list(order_cols)
    work = final_unit(scope.withColumn("_pref", preference_order(scope, order_cols)), aliases, order_cols, extra_keys)
    work = work.filter(F.col("uc_final").isNotNull() & F.col(period).isNotNull())
    work = materialize(work.select(*extra_keys, "uc_final", period, *[F.col(c).alias("_id_" + c) for c in ids], "_pref.*")
                       .withColumn("_rank", preference_rank()).drop("_p1", "_p2", "_p3"))
    keys = [*extra_keys, "uc_final", period]
    # the best preference per key is one number; only rows that reach it meet again, for the row order
    top = work.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    tied = salted_join(work, top, keys, hot_keys(work, keys), spread=order_cols).where("_rank = _best")
    first = tied.groupBy(*keys).agg(F.min(F.struct(*order_cols, *["_id_" + c for c in ids])).alias("_row"))
    return first.select(*extra_keys, *[F.col("_row")["_id_" + c].alias(c) for c in ids], "uc_final")


def preference_rank() -> Column:
    """The preference (``_p1``, ``_p2``, ``_p3``) as one whole-ordered number: the flags stand above every amount of 18 digits."""
    flags = F.col("_p1").cast("int") * 2 + F.col("_p2").cast("int")
    return flags.cast("decimal(1,0)") * F.lit(2 * 10**18).cast("decimal(19,0)") + F.col("_p3").cast("decimal(24,6)")


def restrict_to_portal(df: DataFrame, alias_scope: DataFrame | None = None, order_cols=ORDER,
                       period: str = "period", extra_keys=(), enrich=None) -> DataFrame:
    """P7 -> D9 -> D4 -> V5. Output keeps every input column; ``uc`` is the
    final unit, ``amount`` the charged value (null -> 0), and ``pref_ord`` the
    D4 ordering (used downstream as the stable tie-break). ``enrich`` adds columns
    to the winners (with ``uc_final``) while they are narrow."""
    if "charged_amount" not in df.columns:
        return df
    extra_keys = list(extra_keys)
    aliases = alias_map(alias_scope if alias_scope is not None else df, order_cols, extra_keys)
    scope = df.filter(positive_charge())
    won = portal_winners(scope, aliases, order_cols, period, extra_keys)
    ids = [c for c in won.columns if c != "uc_final"]
    return billed(scope.join(enrich(won) if enrich else won, ids), order_cols)


def billed(rows: DataFrame, order_cols=ORDER) -> DataFrame:
    """V5: winners (with ``uc_final``) under their final unit and charged value, with the D4 ordering ``pref_ord``."""
    return rows.withColumn("pref_ord", preference_order(rows, order_cols)).withColumns({
        "uc": F.col("uc_final"),
        "amount": F.coalesce(F.col("charged_amount").cast("double"), F.lit(0.0)),
    }).drop("uc_final")
