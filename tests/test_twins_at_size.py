"""Queries and their SQL on tables as they come at other sizes: short last frames, prices met twice in an order, scores halfway between two texts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.functions.numbers import fixed
from fathomline.plans import registry

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, twin = registry.QUERIES[name](spark, str(folder)), con.sql(registry.ORACLE_SQL[name])
    at = lambda columns: sorted(range(len(columns)), key=lambda i: columns[i])
    rows = lambda found, columns: sorted((tuple(r[i] for i in at(columns)) for r in found), key=repr)
    found = rows(df.collect(), df.columns)
    assert found == rows(twin.fetchall(), twin.columns)
    return found


@pytest.mark.parametrize("short", [1, 6, 17])
@pytest.mark.parametrize("name", ["bilateral", "clahe", "condition_levels", "condition_standard", "frame_target_stats", "lee_filter", "median_filter", "patch_grid", "qc_speckle"])
def test_last_frame_is_short(spark, tmp_path, name, short):
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id < {50 + short}) TO '{tmp_path}/embeddings.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1) TO '{tmp_path}/lineitem.parquet'")
    assert same(spark, tmp_path, name)


def lines(tmp_path, change):
    """Order lines with one column changed."""
    duckdb.sql(f"COPY (SELECT * REPLACE ({change}) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' LIMIT 1) TO '{tmp_path}/embeddings.parquet'")


@pytest.mark.parametrize("name", ["nms_keep", "tile_merge_keep", "top3_contributions"])
def test_prices_met_twice_in_an_order(spark, tmp_path, name):
    lines(tmp_path, "CASE WHEN l_orderkey % 3 = 0 THEN 5000.0 * (1 + l_partkey % 3) ELSE l_extendedprice END AS l_extendedprice")
    found = same(spark, tmp_path, name)
    if name == "top3_contributions":
        assert len(found) == 3 * duckdb.sql(f"SELECT count(*) FROM '{SF}/lineitem.parquet'").fetchall()[0][0]


def test_scores_halfway_between_two_texts(spark, tmp_path):
    lines(tmp_path, "105000 * (0.005 + 0.01 * (l_partkey % 15)) AS l_extendedprice")
    assert any("raw_score 0.14 <" in r[2] for r in same(spark, tmp_path, "rule_filter"))


def test_fixed_is_what_python_prints(spark):
    rng = random.Random(7)
    numbers = [0.145, 0.125, 0.375, 2.675, 1e11 + 0.125, -0.145, -0.001, 0.0, *[k / 200 for k in range(-300, 300)], *[rng.uniform(-3, 3) for _ in range(300)]]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", fixed(F.col("x"), 2).alias("two"), fixed(F.col("x"), 3).alias("three")).collect()
    assert [(r.two, r.three) for r in got] == [(f"{r.x:.2f}", f"{r.x:.3f}") for r in got]
