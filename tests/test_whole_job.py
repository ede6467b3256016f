"""Queries see all of their input, not a share of it; brute force stands against them on the small tables."""

import math

import duckdb
import numpy as np
import pytest

from fathomline.plans import registry
from fathomline.plans.views import observations


@pytest.fixture(scope="module")
def seen(spark, sf_dir):
    """The detections, read without the view: obs, frame, class, position, uncertainty and box."""
    rows = duckdb.sql(
        f"""SELECT l_orderkey * 200000 + l_extendedprice, l_orderkey, l_returnflag, 12.9::DOUBLE + (l_partkey % 100) * 1e-3::DOUBLE, 80.3::DOUBLE + (l_suppkey % 100) * 1e-3::DOUBLE + l_quantity * 1e-6::DOUBLE,
        l_tax * 50 + 5, l_quantity, (l_partkey % 20)::DOUBLE, l_quantity + (l_tax * 250 + 30), (l_partkey % 20)::DOUBLE + (l_discount * 100 + 20) FROM '{sf_dir}/lineitem.parquet' WHERE l_linestatus = 'F' ORDER BY 1"""
    ).fetchall()
    return rows


def brute_geo(seen):
    cls = np.array([r[2] for r in seen])
    lat, lon, unc = (np.array([r[k] for r in seen], dtype=float) for k in (3, 4, 5))
    out = set()
    for i in range(len(seen)):
        a = np.sin(np.radians(lat[i + 1 :] - lat[i]) / 2) ** 2 + math.cos(math.radians(lat[i])) * np.cos(np.radians(lat[i + 1 :])) * np.sin(np.radians(lon[i + 1 :] - lon[i]) / 2) ** 2
        near = (2 * 6371008.8 * np.arcsin(np.sqrt(a)) <= 12 + 0.5 * (unc[i + 1 :] + unc[i])) & (cls[i + 1 :] == cls[i])
        out |= {(seen[i][0], seen[i + 1 + j][0]) for j in np.flatnonzero(near)}
    return out


def brute_seq(seen):
    cls, frame = np.array([r[2] for r in seen]), np.array([r[1] for r in seen])
    x0, y0, x1, y1 = (np.array([r[k] for r in seen], dtype=float) for k in (6, 7, 8, 9))
    area, out = (x1 - x0) * (y1 - y0), set()
    for i in range(len(seen)):
        rest = slice(i + 1, None)
        inter = np.maximum(np.minimum(x1[rest], x1[i]) - np.maximum(x0[rest], x0[i]), 0) * np.maximum(np.minimum(y1[rest], y1[i]) - np.maximum(y0[rest], y0[i]), 0)
        near = (inter / (area[rest] + area[i] - inter) >= 0.2) & (cls[rest] == cls[i]) & (np.abs(frame[rest] - frame[i]) <= 3)
        out |= {(seen[i][0], seen[i + 1 + j][0]) for j in np.flatnonzero(near)}
    return out


def brute_clusters(seen, edges):
    up = {r[0]: r[0] for r in seen}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_observations_are_all_detections(spark, sf_dir, seen):
    got = observations(spark, sf_dir).select("obs", "frame_index", "cls").collect()
    assert sorted(tuple(r) for r in got) == [r[:3] for r in seen]


def test_edges_and_clusters_of_all_detections(spark, sf_dir, seen):
    edges = brute_geo(seen)
    assert {tuple(r) for r in registry.QUERIES["dedup_geo_edges"](spark, sf_dir).collect()} == edges
    assert {tuple(r) for r in registry.QUERIES["dedup_seq_edges"](spark, sf_dir).collect()} == brute_seq(seen)
    want = brute_clusters(seen, edges)
    assert {r.obs: r.cluster for r in registry.QUERIES["dedup_components"](spark, sf_dir).collect()} == want


def test_register_of_all_detections(spark, sf_dir, seen):
    clusters = brute_clusters(seen, brute_geo(seen))
    members = {}
    for r in seen:
        members.setdefault(clusters[r[0]], []).append(r)
    run = lambda name: registry.QUERIES[name](spark, sf_dir).collect()
    assert {r.cluster: (r.observation_count, r.frames) for r in run("hazard_rollup")} == {c: (len(m), ";".join(sorted({str(r[1]) for r in m}))) for c, m in members.items()}
    order = sorted(members, key=lambda c: (members[c][0][1], members[c][0][6], c))
    names = {c: f"HAZ-{k:05d}" for k, c in enumerate(order, start=1)}
    assert {r.cluster: r.hazard_id for r in run("hazard_numbering")} == names
    summary = run("survey_summary")[0]
    assert (summary.observations, summary.unique_hazards) == (len(seen), len(members))
    assert sum(r.hazards for r in run("hazards_by_class")) == len(members)
    best = {c: max((r[0] - r[1] * 200000) / 105000 for r in m) for c, m in members.items()}
    assert {r.hazard_id for r in run("hazard_register")} == {names[c] for c in members if 100 * best[c] >= 10}
    for name in ("hazard_geojson", "hazard_flat_csv", "report_json"):
        assert {r.hazard_id for r in run(name)} == set(names.values())
    assert {r.unique_hazards for r in run("report_json")} == {len(members)}
    top = run("topk_priority")
    assert len(top) == 10 and {r.hazard_id for r in top} <= set(names.values())
    for name in ("gsd_size", "observation_bands"):
        assert sorted(r.obs for r in run(name)) == [r[0] for r in seen]


@pytest.mark.parametrize("name", ["nav_interpolate", "geo_error_budget", "geodesic_forward"])
def test_all_image_rows_are_placed(spark, sf_dir, name):
    """Every track has its 400 rows, and those that the SQL twin names agree with it."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    tracks = [t for (t,) in con.sql("SELECT DISTINCT user_id FROM events").fetchall()]
    df = registry.QUERIES[name](spark, sf_dir)
    got = {(r.track, r.row): r for r in df.collect()}
    assert set(got) == {(t, row) for t in tracks for row in range(400)}
    twin = con.sql(registry.ORACLE_SQL[name])
    for values in twin.fetchall():
        r = dict(zip(twin.columns, values, strict=True))
        if r["row"] < 400:
            assert got[r["track"], r["row"]].asDict() == pytest.approx(r)
