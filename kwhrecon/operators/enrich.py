"""Metadata enrichment and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhrecon.functions.keys import strip_decimal_suffix
from kwhrecon.operators.late import best_rows


def keep_last(df: DataFrame, key: str = "uc", seq="seq") -> DataFrame:
    """The last row per key in ``seq`` order (a column or several); each task keeps one row per key before the shuffle."""
    order = [F.col(c).desc_nulls_last() for c in ([seq] if isinstance(seq, str) else seq)]
    return best_rows(df, [key], order)


def enrich_left(df: DataFrame, metadata: DataFrame, key: str = "uc", seq: str = "seq",
                reserved=()) -> tuple[DataFrame, list[str]]:
    """Left join of the report rows with the last metadata row per unit;
    metadata columns that already exist on the left are dropped. Returns
    the joined frame and the list of added columns (``reserved`` names, the
    report's own columns, are never added)."""
    meta = keep_last(metadata, key, seq).drop(seq)
    overlap = [c for c in meta.columns if c != key and c in df.columns]
    meta = meta.drop(*overlap)
    added = [c for c in meta.columns if c != key and c not in reserved]
    return df.join(meta, key, "left"), added


def import_rows(new: DataFrame, key_aliases=("uc", "Instalação", "UC", "Nº UC"),
                account: str = "account") -> DataFrame:
    """S6 + F18 for a metadata import: the first present key alias becomes
    ``uc``; key and account lose a trailing ``.0`` and blanks."""
    df = new.toDF(*[c.strip() for c in new.columns])
    found = next((c for c in key_aliases if c in df.columns), None)
    if found is None:
        raise ValueError(f"no unit column among {list(key_aliases)}: {df.columns}")
    if found != "uc":
        df = df.withColumnRenamed(found, "uc")
    df = df.withColumn("uc", strip_decimal_suffix("uc", tokens=()))
    if account in df.columns:
        df = df.withColumn(account, strip_decimal_suffix(account, tokens=()))
    return df


def upsert_keep_last(current: DataFrame, new: DataFrame, key: str = "uc",
                     seq: str = "seq", replace_all: bool = False) -> DataFrame:
    """``replace_all`` keeps only the new rows; otherwise old and new rows
    are unioned and the last row per key wins (new rows after old ones)."""
    if replace_all:
        return new
    both = current.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, ["_batch", seq]).drop("_batch")


def merge_fields(current: DataFrame, updates: DataFrame, key: str = "uc") -> DataFrame:
    """Document merge: every non-null field of an update overwrites the
    stored one; keys only present on either side are kept."""
    cols = [c for c in dict.fromkeys(current.columns + updates.columns) if c != key]
    cur = current.select(key, *[F.col(c).alias("_c_" + c) if c in current.columns
                                else F.lit(None).alias("_c_" + c) for c in cols])
    upd = updates.select(key, *[F.col(c).alias("_u_" + c) if c in updates.columns
                                else F.lit(None).alias("_u_" + c) for c in cols])
    joined = cur.join(upd, key, "full_outer")
    return joined.select(key, *[F.coalesce("_u_" + c, "_c_" + c).alias(c) for c in cols])


def delete_keys(df: DataFrame, keys: DataFrame, key: str = "uc") -> DataFrame:
    """Remove rows whose key is listed (anti join)."""
    return df.join(keys.select(key), key, "left_anti")


def profile_rows(json_docs: DataFrame, value: str = "value", key: str = "uc") -> DataFrame:
    """``{unit: {column: value}}`` JSON documents -> one row per unit and
    column (long form); pivot with ``profile_wide`` for a known column list."""
    parsed = json_docs.select(F.from_json(value, "map<string, map<string, string>>").alias("_m"))
    units = parsed.select(F.explode("_m").alias(key, "_fields"))
    return units.select(key, F.explode("_fields").alias("field", "value"))


def profile_wide(long_rows: DataFrame, fields, key: str = "uc") -> DataFrame:
    """S9 (wide form): one column per known field (missing -> null)."""
    return long_rows.groupBy(key).pivot("field", list(fields)).agg(F.first("value"))


def group_clients(groups: DataFrame, name: str | None = None) -> DataFrame:
    """The clients of the saved group(s), each once, from rows (group_id, group_name, client)."""
    g = groups if name is None else groups.filter(F.col("group_name") == name)
    return g.filter(F.col("client").isNotNull()).select("group_id", "group_name", "client").distinct()


def profile_names(primary: DataFrame, local: DataFrame, profile: str = "profile") -> DataFrame:
    """U4: profile names of both stores, distinct, sorted."""
    return primary.select(profile).union(local.select(profile)).distinct().orderBy(profile)
