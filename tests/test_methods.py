"""Queries leave no generated method too large for HotSpot to compile."""

from kwhrecon.plans import registry
from kwhrecon.session import prepare


def test_queries_keep_generated_methods_compilable(spark):
    old = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        registry.queries()["head_rows"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "12345")
        prepare(spark)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "12345"
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", old)
