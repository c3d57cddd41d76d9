"""Import and maintenance of metadata, each as one call.

Profiles are one table partitioned by profile (K6). Unit documents are kept as
snapshots (K7, K8): each change writes a new folder and the last complete one is
current (S12), so a stopped write changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhrecon.operators import enrich as E
from kwhrecon.session import materialize
from kwhrecon.sources import folders
from kwhrecon.sources.readers import latest_snapshot, load_profile, read_semicolon_csv
from kwhrecon.sources.sinks import delete_write, merge_write, save_profile


def read_profiles(spark: SparkSession, store: str) -> DataFrame | None:
    """All saved profiles, or None where none was saved."""
    if not folders.exists(spark, store):
        return None
    return spark.read.option("mergeSchema", True).parquet(store).withColumn("profile", F.col("profile").cast("string"))


def import_metadata(spark: SparkSession, csv_path: str, store: str, profile: str, replace_all: bool = False,
                    local: DataFrame | None = None) -> DataFrame:
    """A ``;``-separated file (S8, S3) under its key alias (S6, F18) goes into a profile: after the rows the
    profile has (U3; of a unit the last row in file order wins) or, with ``replace_all``, in their place. The profile
    is replaced as a whole (K6), and its rows are returned. ``local`` holds profiles that the store may lack (S11)."""
    raw = read_semicolon_csv(spark, csv_path)
    named = E.import_rows(raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                     F.monotonically_increasing_id().alias("_line")))
    rows = named.where(F.col("uc").isNotNull())
    stored = read_profiles(spark, store)
    if local is not None:
        stored = local if stored is None else load_profile(stored, local)
    if not replace_all:
        current = None if stored is None else stored.where(F.col("profile") == profile).drop("profile")
        rows = rows.withColumn("_new", F.lit(1))
        if current is not None:
            rows = current.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        rows = E.keep_last(rows, "uc", ["_new", "_file", "_block", "_line"]).drop("_new")
    rows = materialize(rows.drop("_file", "_block", "_line"))
    save_profile(rows, store, profile)
    return rows


def delete_profile(spark: SparkSession, store: str, profile: str) -> None:
    """K8 of a whole profile: its partition goes."""
    folders.delete(spark, f"{store.rstrip('/')}/profile={profile}")


class Documents:
    """The metadata documents of units, as snapshots under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> DataFrame:
        return latest_snapshot(self.spark, self.root)

    def _next(self) -> str:
        done = folders.folders_with(self.spark, self.root)
        return f"{self.root}/{int(done[-1].rsplit('/', 1)[1]) + 1 if done else 0:012d}"

    def start(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._next())

    def save(self, updates: DataFrame) -> None:
        """K7: the non-null fields of the updates, the last row of a unit (``seq``) where it has several."""
        merge_write(self.current(), updates, self._next())

    def delete(self, units: DataFrame) -> None:
        """K8: the documents of the listed units go."""
        delete_write(self.current(), units, self._next())
