"""Best row per key (D3-D5): a hot key is combined before its shuffle.

The first row of a key is the first of a window, and Spark limits such a window to one
row per key in every task before its shuffle (``WindowGroupLimit``): rows that cannot win
are never moved or stored, and a hot key brings one row per task. How many rows compete
is a hash aggregate of the keys alone, joined in the partitions of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "row_no"


def _matchable(df: DataFrame, keys) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns that are equal where the keys are, null keys included (a key that may be null as a value and a flag), and the keys out of them."""
    there, back = {}, {}
    for i, k in enumerate(keys):
        kind, value, null = df.schema[k].dataType.simpleString(), f"_k{i}", f"_n{i}"
        if not df.schema[k].nullable:
            there[value], back[k] = F.col(k), F.col(value)
            continue
        stand_in = F.lit("" if kind == "string" else "1970-01-01" if kind in ("date", "timestamp") else 0).cast(kind)
        there |= {value: F.coalesce(F.col(k), stand_in), null: F.col(k).isNull()}
        back[k] = F.when(~F.col(null), F.col(value))
    return there, back


def best_rows(df: DataFrame, keys, order, competes: Column | None = None, count: str | None = None) -> DataFrame:
    """Per key the first row in ``order`` (sort columns; equal ones in the order of the rows) among those that compete,
    and how many do (``count``, if named): keys, columns, ``count``.

    A key of which no row competes has a row of nulls. A null key is a key of its own.
    """
    payload = [c for c in df.columns if c not in keys]
    there, back = _matchable(df, keys)
    flag = F.lit(True) if competes is None else F.coalesce(competes, F.lit(False))
    rows = df.withColumns({**there, "_competes": flag})
    first = Window.partitionBy(*there).orderBy(F.col("_competes").desc(), *order, F.col("_seen"))
    won = (rows.drop(*[k for k in keys if df.schema[k].nullable]).withColumn("_seen", F.monotonically_increasing_id())
           .withColumn("_rank", F.row_number().over(first)).where("_rank = 1"))
    values = [c if competes is None else F.when(F.col("_competes"), F.col(c)).alias(c) for c in payload]
    found = [c.alias(k) for k, c in back.items()]
    if not count:
        return won.select(*found, *values)
    counts = rows.groupBy(*there).agg(F.count_if("_competes").alias(count))
    return won.select(*there, *values).join(counts, list(there)).select(*found, *payload, count)
