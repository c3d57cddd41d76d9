"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# HotSpot never compiles a method of over 8,000 bytes of bytecode. A stage whose generated
# method is larger runs operator by operator, in methods that are compiled.
SMALL_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

# Settings every job relies on: ANSI semantics (try_* casts are used
# explicitly), UTC for date arithmetic, AQE for runtime re-planning of
# joins/partition counts, and skew-join splitting for hot keys.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # generated code for the text-parsing expressions exceeds HotSpot's 8 KB
    # JIT limit; without this flag those methods run interpreted
    **SMALL_METHODS,
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def get_spark(master: str | None = None, app_name: str = "kwhrecon",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    conf = dict(DEFAULT_CONF)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            conf["spark.driver.memory"] = os.environ.get("KWHRECON_DRIVER_MEMORY", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """``SMALL_METHODS`` for a session that the caller built, unless the caller chose a limit."""
    for k, v in SMALL_METHODS.items():
        if spark.conf.get(k) == "65535":  # Spark's default
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster (``spark.checkpoint.dir``).

    A private folder serves only a local session, where driver and executors
    are one machine; on a cluster the setting is required.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    d = tempfile.mkdtemp(prefix="kwhrecon-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Codec of stored tables: smaller than Spark's default, for little more time.
STORED = "zstd"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    lineage is cut, columns and row groups can be pruned, joins see real sizes."""
    path = scratch_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.option("compression", STORED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


def session_key(spark: SparkSession) -> str:
    """Identity of the running application (memo keys survive session objects
    being recreated, and never outlive the application)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", str(id(spark)))
