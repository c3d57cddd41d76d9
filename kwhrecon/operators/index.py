"""Stored indexes that answer without the base: a trigram index for searches (P11), a cube for scopes (A5, A6, T5), sketches per month.

The trigram index keeps (gram, value) of the distinct values, range-partitioned and
sorted by gram, so a search reads the row groups of its own grams only. A value that
has all grams of the term is a candidate and is compared once more; terms of fewer
than three characters, which have no gram, scan the distinct values. The cube has one
row per (client, document, month), so a scope with its document expansion is answered
from the same filters as the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhrecon.functions.dates import normalize_period_value
from kwhrecon.functions.formats import search_normalize
from kwhrecon.functions.keys import doc_digits
from kwhrecon.operators.filters import filter_scope, incomplete
from kwhrecon.sources import folders

GRAM = 3


def grams(normal: Column) -> Column:
    """The distinct substrings of ``GRAM`` characters; empty for shorter text."""
    last = F.length(normal) - GRAM + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(normal, i, F.lit(GRAM))))) \
        .otherwise(F.array().cast("array<string>"))


def build_search_index(df: DataFrame, column: str, path: str) -> None:
    """P11, index: the distinct non-null values of a column and their trigrams, published as a whole."""
    spark, staged = df.sparkSession, folders.staging(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().write.parquet(f"{staged}/values")
    values = spark.read.parquet(f"{staged}/values")
    posted = values.select(F.explode(grams(search_normalize("value"))).alias("gram"), "value")
    posted.repartitionByRange(n, "gram", "value").sortWithinPartitions("gram", "value").write.parquet(f"{staged}/grams")
    folders.publish(spark, staged, path)


def search_values(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The values of the index whose normalised text contains the normalised term."""
    normal, own = spark.range(1).select(search_normalize(F.lit(term)).alias("t")).select("t", grams(F.col("t"))).first()
    if own:
        lists = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(own))
        found = lists.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("value")
    else:
        found = spark.read.parquet(f"{path}/values")
    return found.where(search_normalize("value").contains(normal))


def search_indexed(df: DataFrame, column: str, path: str, term: str | None) -> DataFrame:
    """P11 as ``search_filter``, through the index: a term without letters or digits keeps all rows."""
    if not term or not df.sparkSession.range(1).select(search_normalize(F.lit(term))).first()[0]:
        return df
    found = search_values(df.sparkSession, path, term).withColumnRenamed("value", column)
    return df.join(found, column, "left_semi").select(*df.columns)


def scope_cube(df: DataFrame) -> DataFrame:
    """Rows and incomplete rows per client, document (digits) and month (F5; empty where invalid)."""
    month = normalize_period_value("period")
    return (df.groupBy("client", doc_digits("doc").alias("doc"), month.alias("period"))
            .agg(F.count("*").alias("total_rows"), F.count_if(incomplete()).alias("incomplete_rows")))


def cube_metrics(cube: DataFrame, clients, periods) -> DataFrame:
    """A5 + A6 of any scope (J8 expansion included), from the stored cube."""
    kept = filter_scope(cube, clients, periods)
    return kept.agg(F.coalesce(F.sum("total_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
                    F.coalesce(F.sum("incomplete_rows"), F.lit(0)).cast("bigint").alias("incomplete_rows"))


#: Rows of a sketch: 2 ** 14 registers, a standard error of 0.8 percent.
REGISTERS = 14


def month_sketches(df: DataFrame) -> DataFrame:
    """A9, mergeable: per valid month the rows and a sketch of the clients; the empty month holds the invalid ones."""
    return df.groupBy(normalize_period_value("period").alias("month")).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(F.col("client"), F.lit(REGISTERS)).alias("clients"))


def sketched_metrics(sketches: DataFrame) -> DataFrame:
    """A9 of any set of months: clients (estimated), valid months, rows."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("clients")).alias("clients"),
                        F.count_if(F.col("month") != "").alias("months"), F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"))
