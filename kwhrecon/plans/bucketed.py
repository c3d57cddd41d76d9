"""K1 with J1 and J3: base and charges stored side by side, joined without shuffling the stored side.

Both tables are bucketed and sorted by (unit key, month). The primary join then reads
bucket against bucket; the fallback join shuffles only the base rows, by their
alternative key, to the buckets of the charges. A bucket is read by one task, so this
layout is for keys of which none holds a large share of the base; where one may,
``consolidate`` with its plain shuffle joins is the way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhrecon.operators import reconcile as R
from kwhrecon.session import scratch_path


def store_bucketed(df: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """A bucketed table in the shared folder under a catalog name; returns the table."""
    spark = df.sparkSession
    (df.write.bucketBy(buckets, *R.KEYS).sortBy(*R.KEYS).mode("overwrite")
     .option("path", path or scratch_path(spark, f"{name}-{uuid.uuid4().hex}")).saveAsTable(name))
    return spark.table(name)


def join_bucketed(spark: SparkSession, base_table: str, charge_table: str) -> DataFrame:
    """J1 then J3 of two bucketed tables (``base_keys``, deduped charges)."""
    base, charges = spark.table(base_table), spark.table(charge_table)
    fields = [c for c in R.CHARGE_FIELDS if c in charges.columns]
    left = base.drop(*[c for c in fields if c in base.columns])
    return R.fallback_join(left.join(charges.select(*R.KEYS, *fields), R.KEYS, "left"), charges)
