"""Splits of recordings: leaks between all pairs, and cuts without one task that sorts all."""

from itertools import combinations

import duckdb

from fathomline.operators import store
from fathomline.plans import registry


def test_leaks_of_every_pair(spark):
    rows = [("a", "train"), ("a", "test"), ("b", "train"), ("b", "val"), ("c", "val"), ("c", "test"), ("d", "train"), ("d", "train"), ("e", "train"), ("e", "val"), ("e", "test"), ("f", "test")]
    got = store.leaks(spark.createDataFrame(rows, "r string, s string"), "r", "s", ["train", "val", "test"]).collect()
    assert [r.asDict() for r in got] == [{"leaked": 4, "train_val": 2, "train_test": 2, "val_test": 2}]


def test_leakage_check_reads_the_training_split(spark, sf_dir):
    held = {"train": set(), "val": set(), "test": set()}
    for order, recording in duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{sf_dir}/orders.parquet'").fetchall():
        held[{0: "test", 1: "val"}.get(order % 4, "train")].add(recording)
    pairs = {f"{a}_{b}": held[a] & held[b] for a, b in combinations(held, 2)}
    got = registry.QUERIES["leakage_check"](spark, sf_dir).first().asDict()
    assert got == {"leaked": len(set().union(*pairs.values()))} | {k: len(v) for k, v in pairs.items()}


def test_recording_split_collects_no_hashes(spark, sf_dir):
    plan = registry.QUERIES["recording_split"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Limit" not in plan


def test_ranks_are_whole(spark):
    got = store.ranked(spark.range(1000).selectExpr("id", "pmod(id * 7919, 1009) AS h"), ["h", "id"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001)) and {r["n"] for r in got} == {1000}
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda i: (i * 7919 % 1009, i))
