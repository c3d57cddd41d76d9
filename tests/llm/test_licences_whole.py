"""Inheritance over several levels through the registered query and its SQL: sources may be folders."""

from kwhrecon.llm import licences


def test_inheritance_over_levels_through_the_query(spark, tmp_path):
    import duckdb
    mit, gpl = licences.TEMPLATES[5][1], licences.TEMPLATES[4][1]
    rows = [(1, mit, "a"), (2, "no notice", "a/0/0/b"), (3, "none", "a/0/0/b/0/0/c"), (4, gpl, "a/0/0/b"), (60, "far", "a"), (5, "x", "a"), (6, "y", "q")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in licences.query(spark, str(tmp_path)).select("doc_id", "licence", "how", "from_dir").collect()}
    assert {(5, "MIT", "directory", "a/0/0/"), (2, "GPL-3.0", "directory", "a/0/0/b/0/0/"), (3, "GPL-3.0", "directory", "a/0/0/b/0/0/"),
            (60, None, "none", None), (6, None, "none", None)} <= got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.execute(f"SELECT doc_id, licence, how, from_dir FROM ({licences.SQL})").fetchall())
