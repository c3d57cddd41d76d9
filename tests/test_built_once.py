"""What the shared build does once: amounts out of winners alone, rows written by counted months, tables when they are asked for."""

import os
import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kwhrecon.operators import reconcile as R
from kwhrecon.plans import consolidate as CO
from kwhrecon.plans import tables as T


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def charges(spark):
    rng = random.Random(11)
    pick = lambda *values: rng.choice(values)
    rows = [(f"c{rng.randrange(200):03d}", pick(None, "", "7.0", "07", "x8", f"{i % 40}"), pick("01/2031", "02/2031", "bad", None),
             pick("01/03/2031", "2031-04-01", "x", None), pick("Pago", None), pick("Sim", "Não", None), pick("1.234,50", "7", "-", None),
             pick("5.0", None), pick("111", "", None)) for i in range(400)]
    return spark.createDataFrame(rows, "charge_id string, uc string, period string, due_date string, status string, cancelled string, "
                                       "charged_amount string, account string, doc string")


def test_amounts_are_read_out_of_the_winners(charges, monkeypatch):
    seen, dedupe = [], R.dedupe_charges
    monkeypatch.setattr(R, "dedupe_charges", lambda df, **kw: seen.append(df.columns) or dedupe(df, **kw))
    # rows that are equal in key and order differ in nothing that decides: one of each, so that both ways pick the same
    one = charges.dropDuplicates(["charge_id"])
    got = CO.aggregate_charges(one, checkpoint=False)
    assert "portal_uc" not in seen[0]
    want = dedupe(R.charge_keys(one).drop("uc", "period"), active=R.active_charge())
    columns = [*R.KEYS, "charge_id", "portal_uc", "due_date", "charge_status", "charged_amount", "account", "doc", "is_dup", "dup_count"]
    assert rows_of(got.per_key.select(*columns)) == rows_of(want.select(*columns))
    assert got.per_key.schema["charged_amount"].dataType == want.schema["charged_amount"].dataType
    assert rows_of(got.unit_keys) == rows_of(got.keyed.select("uc_key").distinct().withColumn("_in_charges", F.lit(True)))


def test_an_order_by_a_read_column_reads_it_before(charges, monkeypatch):
    seen, dedupe = [], R.dedupe_charges
    monkeypatch.setattr(R, "dedupe_charges", lambda df, **kw: seen.append(df.columns) or dedupe(df, **kw))
    CO.aggregate_charges(charges, charge_order=("charged_amount", "charge_id"), checkpoint=False)
    CO.aggregate_charges(charges.drop("charge_id"), charge_order=("due_date",), checkpoint=False)
    assert all("portal_uc" in columns for columns in seen)


def test_rows_are_computed_once_and_shared_evenly(spark):
    # a month of half of all rows, small months, rows without month; a tenth of the rows are there twice
    rows = [(0, f"r{i - i % 10 // 9:05d}", None if i % 3 else f"{i}", None if i % 40 == 0 else f"2031-{1 + (i % 24) // 2 if i % 2 else 1:02d}-01") for i in range(8000)]
    plain = spark.createDataFrame(rows, "src int, row_id string, uc_key string, m string").withColumn("period_month", F.col("m").cast("date"))
    computed = spark.sparkContext.accumulator(0)

    def count(r):
        computed.add(1)
        return r

    df = spark.createDataFrame(plain.rdd.map(count), plain.schema)
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "cons")
    CO.write_consolidated(df, path, partitions=8, months=plain)
    assert computed.value == 8000
    back = spark.read.parquet(path)
    assert rows_of(back.select(*plain.columns)) == rows_of(plain)
    files = [(r.f, r.n) for r in back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    tasks = Counter()
    for name, n in files:
        tasks[re.search(r"part-(\d+)", name).group(1)] += n
    assert len(tasks) == 8 and max(tasks.values()) <= 1.25 * 1000 and len(files) <= 8 + 13


def test_an_empty_table_is_written(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "cons")
    empty = spark.createDataFrame([], "src int, row_id string, uc_key string, period_month date")
    CO.write_consolidated(empty, path)
    assert spark.read.schema(empty.schema).parquet(path).count() == 0


@pytest.fixture
def tables(spark):
    d = tempfile.mkdtemp(prefix="run-")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    ts = F.col("d").cast("timestamp")
    put("nation", [(1, "N")], "n_nationkey int, n_name string")
    put("customer", [(i, f"C{i}", 1) for i in range(5)], "c_custkey long, c_name string, c_nationkey int")
    orders = [(i, i % 5, "F", 10.5 * i, f"1996-0{1 + i % 3}-11", "2-HIGH") for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string, o_orderpriority string") \
        .withColumn("o_orderdate", ts).write.parquet(f"{d}/orders.parquet")
    lines = [(i % 45, i, 3, 1 + i % 7, 20.0, 99.5 + i, "R" if i % 2 else "N", "1996-04-01") for i in range(120)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_returnflag string, d string").withColumn("l_shipdate", ts).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_a_table_is_built_when_it_is_asked_for(spark, tables, monkeypatch):
    written, write = [], T.write_consolidated
    monkeypatch.setattr(T, "write_consolidated", lambda df, path, **kw: written.append(path) or write(df, path, **kw))
    res = T.consolidation(spark, tables)
    assert 0 < res.deduped.count() <= 120 and not written
    cons = T.consolidated(spark, tables)
    assert T.consolidation(spark, tables).deduped is res.deduped
    files = res.gaps.inputFiles()
    assert len(written) == 1 and any(os.path.basename(written[0]) in f for f in files)
    whole = CO.consolidate(T.base(spark, tables), T.charges(spark, tables))
    assert cons.schema.names == whole.consolidated.schema.names and cons.count() >= 60
    assert [f.dataType for f in cons.schema] == [f.dataType for f in whole.consolidated.schema]
    assert rows_of(cons.drop("row_no")) == rows_of(whole.consolidated.drop("row_no"))
    assert res.gaps.count() > 0 and rows_of(res.gaps.drop("row_no")) == rows_of(whole.gaps.drop("row_no"))
