"""The registered queries against DuckDB, the pipeline, and the shared helpers."""

import random

import pytest

import __spark_entry__ as E
import corpus_pipeline
from kwhrecon.llm import common, queries
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, rows) == digest(columns, cur.fetchall())


def test_all_queries_are_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, tmp_path):
    docs = common.read(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "substring_dedup", "soft_mixing", "bpe_round_trip"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= ids
        ids = kept[-1]
    assert kept[1] < kept[0] and kept[3] == kept[2] == kept[4]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (60, 70), (40, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(12)] + [(None, 1), (5, 5)]
        got = {r["node"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        label = {}
        for a, b in edges:
            if a is not None and a != b:
                label.setdefault(a, a), label.setdefault(b, b)
        for _ in range(200):
            for a, b in edges:
                if a in label and b in label:
                    label[a] = label[b] = min(label[a], label[b])
        assert got == label
