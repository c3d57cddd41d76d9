"""Folders of tables: existence, publishing by rename, complete snapshots.

Uses the file system API that Spark itself uses, so any store works; only
names of folders are listed, never the files of a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put a written folder in the place of ``path``; what lay there goes once the new folder stands beside it."""
    fs, new = _at(spark, staged)
    _, final = _at(spark, path)
    if fs.exists(final):
        _, old = _at(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
        fs.rename(final, old)
        fs.rename(new, final)
        fs.delete(old, True)
    else:
        fs.mkdirs(final.getParent())
        fs.rename(new, final)


def staging(path: str) -> str:
    """A folder beside ``path`` to write to before publishing."""
    return f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"


def folders_with(spark: SparkSession, root: str, marker: str = "_SUCCESS") -> list[str]:
    """Folders directly under ``root`` that hold the marker of a finished write, in the order of their names."""
    fs, p = _at(spark, f"{root.rstrip('/')}/*/{marker}")
    return sorted(str(s.getPath().getParent().toString()) for s in fs.globStatus(p) or [])


def write_months(df: DataFrame, path: str, months, column: str = "period_month", counted: DataFrame | None = None) -> None:
    """Replace some partitions of a table by month; the others keep their files. Months without rows go.

    Rows are placed by the number of rows of each month, which ``counted`` (a table with the same months and rows,
    by default ``df``) gives."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (df if counted is None else counted).groupBy(column).count().collect()  # bounded by the calendar
    (df.repartitionById(n, month_task(df, n, counts, column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))
    left = {r[column] for r in counts}
    for m in set(months) - left:
        delete(spark, f"{path.rstrip('/')}/{column}={'__HIVE_DEFAULT_PARTITION__' if m is None else m.isoformat()}")


def month_task(df: DataFrame, n: int, counts, column: str = "period_month") -> Column:
    """The task of each row: every month has a stretch of the ``n`` tasks as long as its share of the rows."""
    total, starts, before = max(1, sum(r["count"] for r in counts)), {}, 0
    for r in sorted(counts, key=lambda r: str(r[column] or "")):
        starts[str(r[column] or "")] = (before * n / total, r["count"] * n / total)
        before += r["count"]
    if not starts:
        return F.lit(0)
    month = F.coalesce(F.col(column).cast("string"), F.lit(""))
    places = F.map_from_arrays(F.array(*map(F.lit, starts)), F.array(*[F.array(F.lit(s), F.lit(w)) for s, w in starts.values()]))
    spread = [c for c in ("src", "row_id") if c in df.columns] or df.columns
    part = F.pmod(F.xxhash64(*spread), F.lit(2**31)) / F.lit(float(2**31))
    place = F.try_element_at(places, month)
    return F.coalesce(F.least(F.floor(place[0] + part * place[1]), F.lit(n - 1)), F.lit(0)).cast("int")
