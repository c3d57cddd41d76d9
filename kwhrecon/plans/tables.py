"""The derived tables and the consolidated table of an input folder.

The consolidated table is built once per application and state of the input
files, written by month (K1) to the shared folder and read back, so report
queries read only the columns and months they need. The charge aggregate below it
is stored by itself: what asks only for that does not wait for the table.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhrecon.operators import reconcile as R
from kwhrecon.plans.consolidate import Charges, aggregate_charges, consolidate, write_consolidated
from kwhrecon.session import scratch_path, session_key
from kwhrecon.sources import fixtures as X

_MEMO: dict = {}


def _key(spark: SparkSession, sf_dir: str):
    """Application, folder and last change of the files read: a rewritten input is built anew."""
    state = []
    for t in ("orders", "lineitem", "customer", "nation"):
        files = X.read_table(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_modification_time").distinct()
        state.append(tuple(files.agg(F.count("*"), F.max("file_modification_time"), F.max("file_path")).first()))
    return session_key(spark), sf_dir, tuple(state)


def base(spark, sf_dir) -> DataFrame:
    return X.base_table(spark, sf_dir)


def charges(spark, sf_dir) -> DataFrame:
    return X.charges_table(spark, sf_dir)


def metadata(spark, sf_dir) -> DataFrame:
    return X.metadata_table(spark, sf_dir)


def groups(spark, sf_dir) -> DataFrame:
    return X.client_groups_table(spark, sf_dir)


def group_periods(spark, sf_dir) -> DataFrame:
    return X.group_periods_table(spark, sf_dir)


class Stored:
    """The consolidation of an input folder, each table built and stored when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def aggregate(self) -> Charges:
        return aggregate_charges(charges(self.spark, self.sf_dir))

    @property
    def charges_keyed(self) -> DataFrame:
        return self.aggregate.keyed

    @property
    def deduped(self) -> DataFrame:
        return self.aggregate.deduped

    @property
    def unit_keys(self) -> DataFrame:
        return self.aggregate.unit_keys

    @cached_property
    def consolidated(self) -> DataFrame:
        """The table as written by month and read back."""
        res = consolidate(base(self.spark, self.sf_dir), charges(self.spark, self.sf_dir), known=self.aggregate)
        cons = res.consolidated
        path = scratch_path(self.spark, f"consolidated-{uuid.uuid4().hex}")
        write_consolidated(cons, path, months=res.months)
        return self.spark.read.schema(cons.schema).parquet(path).select(*cons.columns)

    @property
    def gaps(self) -> DataFrame:
        """C5 from the stored table: the backfill is not done again."""
        return R.gap_rows(self.consolidated, self.unit_keys)


def consolidation(spark: SparkSession, sf_dir: str) -> Stored:
    k = _key(spark, sf_dir)
    if k not in _MEMO:
        _MEMO[k] = Stored(spark, sf_dir)
    return _MEMO[k]


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation(spark, sf_dir).consolidated
