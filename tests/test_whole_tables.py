"""Queries read whole tables."""

from fathomline.plans import registry


def test_set_except_takes_every_order(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 10.0), (2, 400000.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.id for r in registry.QUERIES["set_except"](spark, str(tmp_path)).collect()] == [3]
    assert "o_totalprice" not in registry.ORACLE_SQL["set_except"]
