from __future__ import annotations

from foldspark.plans import catalog
from tests.oracle import connection, same


def test_semi_anti_counts_customers_without_any_order(spark, tmp_path):
    spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, "5-LOW"), (2, "5-LOW")], "o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in catalog.QUERIES["semi_anti"](spark, str(tmp_path)).collect()] == [("B", 2)]
    assert "o_orderpriority" not in catalog.ORACLE_SQL["semi_anti"]


def test_semi_anti_equals_its_sql_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    same(catalog.QUERIES["semi_anti"](spark, folder), connection(folder), catalog.ORACLE_SQL["semi_anti"])
