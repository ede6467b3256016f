"""How observations become hazards: reach, wrap, modes; and the register's documents."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import geo as G
from fathomline.operators import dedup, matching, reports
from fathomline.sources import writers

OBS = "obs long, cls string, frame_index long, lat double, lon double, unc double, confidence double, x0 double, y0 double, x1 double, y1 double"


def metres(p, q):
    a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
    return 2 * G.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(a)))


def brute(rows, class_aware=True):
    rows = [(i, lat, lon, unc or 0.0, cls) for i, cls, lat, lon, unc in rows if lat is not None and lon is not None]
    return {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and (not class_aware or p[4] == q[4]) and metres(p, q) <= 12 + 0.5 * (p[3] + q[3])}


def edges(spark, rows, **options):
    got = dedup.geographic_edges(spark.createDataFrame(rows, "obs long, cls string, lat double, lon double, unc double"), **options).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    return {(r.a, r.b) for r in got}


def roots(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("centre", [(0.0, 0.0), (12.9, 80.3), (60.0, 179.99995), (-45.0, -180.0), (89.9999, 10.0), (-89.99995, 170.0), (0.0, 180.0)])
def test_edges_anywhere(spark, centre):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(220):
        lat = min(90.0, max(-90.0, centre[0] + float(rng.normal(0, 3e-4))))
        lon = centre[1] + float(rng.normal(0, 3e-4)) / max(math.cos(math.radians(lat)), 1e-4)
        rows.append((i, "ab"[i % 2], lat, (lon + 180) % 360 - 180, float(rng.choice([0.0, 1.0, 5.0, 20.0, 300.0])) if i % 11 else None))
    rows.append((999, "a", None, 1.0, 5.0))
    assert edges(spark, rows) == brute(rows) and edges(spark, rows, class_aware=False) == brute(rows, False)


def test_across_the_date_line(spark):
    rows = [(1, "a", 10.0, 179.99999, 0.0), (2, "a", 10.0, -179.99999, 0.0), (3, "a", 10.0, 179.9, 0.0)]
    assert edges(spark, rows) == {(1, 2)}


def test_one_poor_fix_widens_its_own_cells_only(spark):
    """A fix that is good to 200 km pairs with all; the others meet on small cells, as the level of a pair's grid is that of its larger reach."""
    rows = [(i, "a", 12.0 + 1e-3 * i, 80.0, 2.0) for i in range(150)] + [(1000, "a", 12.0, 80.0, 200_000.0)]
    assert edges(spark, rows) == brute(rows) and len(brute(rows)) == 150
    df = spark.createDataFrame(rows, "obs long, cls string, lat double, lon double, unc double")
    levels = df.select(dedup._level(0.5 * (12.0 + F.col("unc"))).alias("level")).groupBy("level").count().collect()
    assert sorted(r["count"] for r in levels) == [1, 150]


def test_empty_and_unlocated(spark):
    assert edges(spark, [(1, "a", None, None, None)]) == set() and edges(spark, []) == set()


def observations(spark, rows):
    return spark.createDataFrame(rows, OBS)


def test_modes(spark):
    box = (0.5, 0.0, 0.0, 10.0, 10.0)
    placed = [(i, "a", i, 12.9 + 1e-5 * (i % 2) + 0.1 * (i // 2), 80.3, 1.0, *box) for i in range(6)]
    clusters, mode = dedup.associate(observations(spark, placed))
    assert mode == "geographic" and {r.obs: r.cluster for r in clusters.collect()} == {i: i // 2 * 2 for i in range(6)}
    nowhere = [(i, "a", i * (1 if i < 3 else 10), None, None, None, *box) for i in range(6)]
    clusters, mode = dedup.associate(observations(spark, nowhere))
    assert mode == "sequence" and {r.obs: r.cluster for r in clusters.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    # One row without a position sends all of them to the sequence, where they overlap frame by frame.
    mixed = placed[:5] + [(5, "a", 5, None, 80.3, 1.0, *box)]
    clusters, mode = dedup.associate(observations(spark, mixed))
    assert mode == "mixed" and {r.cluster for r in clusters.collect()} == {0}
    hazard = dedup.rollup(observations(spark, mixed), clusters).first()
    assert hazard.observation_count == 6 and hazard.lat == pytest.approx(np.mean([r[3] for r in mixed[:5]]))
    assert dedup.association_mode(observations(spark, [])) == "geographic"


def test_links_connect_what_edges_connect(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[int(rng.integers(2))], 1, 12.0 + 1e-4 * int(rng.integers(12)), 80.0 + 1e-4 * int(rng.integers(12)), float(rng.choice([0.0, 2.0, 9.0])), 0.5, 0.0, 0.0, 1.0, 1.0) for i in range(400)]
    obs = observations(spark, rows)
    for aware in (True, False):
        by_edges = roots([r[0] for r in rows], {(r.a, r.b) for r in dedup.geographic_edges(obs, class_aware=aware).collect()})
        links = dedup.geographic_links(obs, class_aware=aware)
        assert roots([r[0] for r in rows], {(r.a, r.b) for r in links.collect()}) == by_edges
        assert {r.obs: r.cluster for r in dedup.components(obs, links).collect()} == by_edges


def test_one_place_that_most_share(spark):
    """A third of all rows at one position are links to one of them, not pairs."""
    rows = [(i, "a", 1, 12.0, 80.0, 0.0, 0.5, 0.0, 0.0, 1.0, 1.0) for i in range(3000)]
    assert dedup.geographic_links(observations(spark, rows)).count() == 2999


def test_means_do_not_depend_on_order(spark):
    rows = [(i, "a", i, 12.9 + 1e-7 * i, 80.3, 1.0, 0.1 * (i % 7), 0.0, 0.0, 10.0, 10.0) for i in range(50)]
    obs = observations(spark, rows)
    one = obs.select("obs", F.lit(0).cast("long").alias("cluster"))
    got = {tuple(dedup.rollup(obs.repartition(k), one).select("lat", "mean_confidence").first()) for k in (1, 3, 7, 13)}
    assert len(got) == 1 and next(iter(got))[0] == pytest.approx(12.9 + 1e-7 * 24.5)


def test_evidence_of_the_best_member(spark):
    rows = [(1, "A", 4, 12.9, 80.3, 5.0, 0.6, 0.0, 0.0, 9.0, 9.0), (2, "A", 5, 12.9, 80.3, 5.0, 0.9, 1.0, 1.0, 8.0, 8.0)]
    obs = observations(spark, rows).withColumns({"raw": F.col("confidence") / 2, "quality": F.col("frame_index") / 10, "calibrated": F.lit(True), "reason": F.lit("fine"), "method": F.lit("geotiff_affine")})
    record = reports.with_utm(reports.hazard_records(dedup.number(dedup.rollup(obs, dedup.associate(obs)[0])), {"A": ("MILCO", "MAN_MADE", "mine_like_object")}, gsd=0.1)).first()
    assert (record.raw_detector_score, record.frame_quality_score, record.calibrated, record.fp_filter_verdict, record.geolocation_method, record.utm_zone) == (0.45, 0.5, True, "fine", "geotiff_affine", "44N")
    assert record.notes == [] and record.estimated_length_m == pytest.approx(0.8) and record.hazard_id == "HAZ-00001"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, "A", i * 10, None if i == 2 else 12.9 + 0.1 * i, 80.3, 5.0, 0.5 + 0.1 * i, 0.0, 0.0, 9.0, 9.0) for i in range(4)]
    obs = spark.createDataFrame(rows, OBS)
    return reports.hazard_records(dedup.number(dedup.rollup(obs, obs.select("obs", F.col("obs").alias("cluster")))), {"A": ("MILCO", "MAN_MADE", "mine_like_object")}, 0.8)


def joined(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_documents(spark, records, tmp_path):
    assert writers.write_geojson(records, str(tmp_path / "g")) == 1
    collection = joined(tmp_path / "g")
    assert collection["type"] == "FeatureCollection" and collection["omitted_without_position"] == 1 and len(collection["features"]) == 3
    assert [f["properties"]["hazard_id"] for f in collection["features"]] == ["HAZ-00001", "HAZ-00002", "HAZ-00004"] and collection["features"][0]["geometry"]["coordinates"] == [80.3, 12.9]
    writers.write_report(records, str(tmp_path / "r"), {"survey_id": "S1", "unique_hazards": 4}, {"model": "x"}, "1.0", "2026-01-01T00:00:00Z")
    report = joined(tmp_path / "r")
    assert report["survey"] == {"survey_id": "S1", "unique_hazards": 4} and report["provenance"] == {"model": "x"} and report["generator"]["version"] == "1.0" and "RAW detector scores" in report["disclaimer"]
    assert [h["hazard_id"] for h in report["hazards"]] == [f"HAZ-0000{k}" for k in range(1, 5)] and report["hazards"][2]["latitude"] is None and report["hazards"][0]["evidence"]["data_quality"] == 0.8
    nothing = records.filter("hazard_id = ''")
    writers.write_report(nothing, str(tmp_path / "e"), {"survey_id": "S1"}, {}, "1.0", "now")
    writers.write_geojson(nothing, str(tmp_path / "f"))
    assert joined(tmp_path / "e")["hazards"] == [] and joined(tmp_path / "f")["features"] == []


def test_summary(spark, records):
    n = spark.createDataFrame([(9,)], "observations long")
    frames = spark.createDataFrame([(0.5,), (1.0,)], "quality_score double")
    found = spark.createDataFrame([(True,), (True,), (False,), (False,)], "accepted boolean")
    s = reports.summary(records, n, frames, found).first()
    assert (s.unique_hazards, s.frames_processed, s.mean_frame_quality, s.candidate_detections_raw, s.detections_accepted, s.detections_rejected, s.rejection_rate) == (4, 2, 0.75, 4, 2, 2, 0.5)
    empty = reports.summary(records.limit(0), n, frames.limit(0), found.limit(0)).first()
    assert (empty.unique_hazards, empty.rejection_rate, empty.mean_frame_quality, empty.deduplication_ratio) == (0, 0.0, 0.0, 0.0)


def test_splits_and_scenarios(spark, tmp_path):
    frames = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "frame int, split string")
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (9, "z")], "frame int, cls string")
    writers.write_splits(frames, str(tmp_path / "s"), labels)
    got = {r["split"]: r for r in spark.read.json(str(tmp_path / "s/manifest")).collect()}
    assert got["train"]["objects"].asDict() == {"a": 2, "b": 1} and (got["train"]["frames"], got["train"]["positive_frames"], got["train"]["negative_frames"], got["train"]["total_objects"]) == (2, 1, 1, 3)
    assert (got["test"]["frames"], got["test"]["total_objects"]) == (1, 0) and spark.read.parquet(str(tmp_path / "s/data")).count() == 3
    info = spark.createDataFrame([("a", "First", True), ("b", "None", None)], "scenario string, title string, synthetic_navigation boolean")
    listed = writers.scenarios(spark.createDataFrame([("a", "y"), ("a", "x")], "scenario string, frame string"), info).collect()
    told = {r.scenario: json.loads(r.value) for r in listed}
    assert told["a"]["frames"] == ["x", "y"] and told["a"]["navigation"].startswith("SYNTHETIC") and told["b"]["frames"] == [] and told["b"]["navigation"].startswith("none")


def plain_ap(flags, n):
    """All-point area under the envelope; flags are (score, hit)."""
    points, found, seen = [], 0, 0
    for score in sorted({s for s, _ in flags}, reverse=True):
        found += sum(h for s, h in flags if s == score)
        seen += sum(s == score for s, _ in flags)
        points.append((found / n, found / seen))
    area, before = 0.0, 0.0
    for k, (recall, _) in enumerate(points):
        area += (recall - before) * max(p for _, p in points[k:])
        before = recall
    return area


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter, 1e-9)


def test_mean_precision_against_loops(spark):
    rng = np.random.default_rng(3)
    truths, dets = [], []
    for frame in range(12):
        for k in range(4):
            x, y = rng.random(2) * 40
            truths.append((frame, k, "ab"[k % 2], float(x), float(y), float(x + 10), float(y + 10)))
            for j in range(2):
                dx, dy = rng.normal(0, 1.5, 2)
                dets.append((frame, 10 * k + j, "ab"[k % 2], float(x + dx), float(y + dy), float(x + dx + 10), float(y + dy + 10), float(np.round(rng.random(), 1))))
    want = {}
    for cls in "ab":
        per = []
        for level in matching.LEVELS:
            flags = []
            for frame in range(12):
                free = [t for t in truths if t[0] == frame and t[2] == cls]
                for d in sorted((d for d in dets if d[0] == frame and d[2] == cls), key=lambda d: (-d[7], d[1])):
                    best = max(free, key=lambda t: (overlap(d[3:7], t[3:7]), -t[1]), default=None)
                    hit = best is not None and overlap(d[3:7], best[3:7]) >= level
                    if hit:
                        free.remove(best)
                    flags.append((d[7], int(hit)))
            per.append(plain_ap(flags, sum(t[2] == cls for t in truths)))
        want[cls] = (per[0], np.mean(per))
    columns = "frame int, idx int, cls string, x0 double, y0 double, x1 double, y1 double"
    got = {r.cls: (r.ap50, r.ap50_95) for r in matching.mean_precision(spark.createDataFrame(dets, columns + ", score double"), spark.createDataFrame(truths, columns)).collect()}
    assert set(got) == {"a", "b", None}
    assert all(got[c] == pytest.approx(want[c]) for c in "ab") and got[None] == pytest.approx(tuple(np.mean([want["a"], want["b"]], axis=0)))


def test_precision_of_nothing(spark):
    totals = spark.createDataFrame([("a", 3), ("b", 0)], "cls string, n_gt long")
    flags = spark.createDataFrame([("b", 0.5, 0)], "cls string, score double, tp int")
    got = {r.cls: (r.n_det, r.ap) for r in matching.average_precision(flags, totals, ["cls"]).collect()}
    assert got == {"a": (0, 0.0), "b": (1, None)}


def test_rows_close_together_are_linked_in_proportion(spark):
    """Rows within the radius of each other, at places of their own: one link each, not one a pair; cells meet once."""
    rows = [(k, "A", 12.9 + (k % 40) * 1e-6, 80.3 + (k // 40) * 1e-6, 5.0) for k in range(1600)]
    obs = spark.createDataFrame(rows, "obs long, cls string, lat double, lon double, unc double")
    links = dedup.geographic_links(obs)
    assert links.count() < 1620
    assert {r.cluster for r in dedup.components(obs, links).collect()} == {0}


def test_rows_without_class_stand_alone(spark):
    obs = spark.createDataFrame([(1, None, 1.0, 1.0, 5.0), (2, None, 1.0, 1.0, 5.0), (3, "A", 1.0, 1.0, 5.0), (4, "A", 1.0, 1.0, 5.0)], "obs long, cls string, lat double, lon double, unc double")
    assert {r.obs: r.cluster for r in dedup.associate(obs)[0].collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_components_of_long_chains(spark):
    edges = spark.range(3000).selectExpr("id as a", "id + 1 as b").filter("a % 1000 <> 999")
    got = dedup.components(spark.range(3000).selectExpr("id as obs"), edges).collect()
    assert len(got) == 3000 and all(r.cluster == r.obs // 1000 * 1000 for r in got)


@pytest.mark.parametrize("centre", [(12.9, 80.3), (60.0, 179.99995)])
def test_neighbours_are_counted_as_edges_are(spark, centre):
    rng = np.random.default_rng(6)
    rows = [(1000, "a", None, 1.0, 5.0), (1001, None, *centre, 5.0)]
    for i in range(250):
        lat, lon = centre[0] + float(rng.integers(-9, 9)) * 3e-5, centre[1] + float(rng.integers(-9, 9)) * 3e-5
        rows.append((i, "ab"[i % 2], lat, (lon + 180) % 360 - 180, float(rng.choice([0.0, 1.0, 5.0, 90.0])) if i % 11 else None))
    pairs = brute([r for r in rows if r[1]])
    of_class = roots([r[0] for r in rows], pairs)
    links = {r[0]: sum(r[0] in p for p in pairs) for r in rows}
    got = dedup.geographic_neighbours(spark.createDataFrame(rows, "obs long, cls string, lat double, lon double, unc double")).collect()
    assert sorted((r.obs, r.cluster, r.links) for r in got) == sorted((r[0], of_class[r[0]], links[r[0]]) for r in rows)


def test_cells_that_are_near_as_a_whole_are_one_pair(spark):
    """Two cells of 1,500 rows each, all within reach: one pair of cells and no pair of rows, and 2,999 links a row."""
    rows = [(i, "a", 12.0, 80.0 + 1e-8 * i + 5e-5 * (i % 2), 9.0) for i in range(3000)]
    obs = spark.createDataFrame(rows, "obs long, cls string, lat double, lon double, unc double")
    cells = dedup._spots(dedup._in_cells(obs, 12.0, True))[1]
    assert cells.count() == 2 and [r["all"] for r in dedup._cell_pairs(cells, 12.0).collect()] == [True]
    assert {(r.cluster, r.links) for r in dedup.geographic_neighbours(obs).collect()} == {(0, 2999)}


def test_rows_of_one_identifier_count_once_each(spark, tmp_path):
    """Two lines of one price in an order were four observations when clusters met their rows by identifier."""
    from fathomline.plans import register

    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, 1, 1, k, 5.0, 900.0, 0.0, 0.0, "A", "F") for k in (1, 2)] + [(2, 1, 1, 1, 5.0, 901.0, 0.0, 0.0, "A", "F")], columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r.observation_count, r.frames) for r in register.hazard_rollup(spark, str(tmp_path)).collect()] == [(3, "1;2")]


def test_areas_of_several_levels_at_once(spark):
    """A score is one row with its hits at each level; each level has the area that it has alone."""
    cells = spark.createDataFrame([("a", 0.9, 2, 1, 2), ("a", 0.5, 1, 1, 0), ("a", 0.2, 3, 1, 1), ("b", 0.4, 1, 0, 1)], "cls string, score double, _n long, u long, v long")
    totals = spark.createDataFrame([("a", 4), ("b", 2)], "cls string, n_gt long")
    got = {r.cls: (r.u, r.v) for r in matching._area_of(cells, totals, ["cls"], ["u", "v"]).collect()}
    assert got["a"] == pytest.approx(((2 / 3 + 2 / 3 + 0.5) / 4, 2.5 / 4)) and got["b"] == pytest.approx((0.0, 0.5))


def test_query_of_edges_returns_every_pair(spark, tmp_path):
    """Each two rows of one class in reach are a row; a cluster and a number of links don't tell which rows they join."""
    from fathomline.plans import register, registry

    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    # A quantity is 0.108 m to the east and 17 m are in reach, so 1 meets 100 and 200 meets 100 and 300; one more is of another class, one elsewhere, one of status O.
    lines = [(1, 1, 1, "A", 1.0, "F"), (2, 1, 1, "A", 200.0, "F"), (3, 1, 1, "A", 300.0, "F"), (4, 1, 1, "R", 200.0, "F"), (5, 2, 1, "A", 200.0, "F"), (6, 1, 1, "A", 200.0, "O"), (7, 1, 1, "A", 100.0, "F")]
    spark.createDataFrame([(o, p, s, 1, q, 900.0, 0.0, 0.0, c, f) for o, p, s, c, q, f in lines], columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = register.dedup_geo_edges(spark, str(tmp_path))
    obs = {k: k * 200000 + 900.0 for k in range(8)}
    assert df.columns == ["a", "b"] and sorted(tuple(r) for r in df.collect()) == [(obs[1], obs[7]), (obs[2], obs[3]), (obs[2], obs[7])]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(con.sql(registry.ORACLE_SQL["dedup_geo_edges"]).fetchall()) == [(obs[1], obs[7]), (obs[2], obs[3]), (obs[2], obs[7])]


@pytest.mark.parametrize("centre", [(12.9, 80.3), (60.0, 179.99995)])
def test_edges_of_crowded_cells_meet_block_by_block(spark, centre, monkeypatch):
    """Cells of several blocks, wholly and partly in reach of each other; fixes said to be better than none make a cell's own rows miss each other."""
    monkeypatch.setattr(dedup, "BLOCK", 16, raising=False)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        lat, lon = centre[0] + float(rng.integers(-4, 4)) * 3e-5, centre[1] + float(rng.normal(0, 6e-5))
        rows.append((i, "ab"[i % 5 == 0], lat, (lon + 180) % 360 - 180, float(rng.choice([0.0, 5.0, 9.0, -9.0]))))
    assert edges(spark, rows) == brute(rows) and edges(spark, rows, class_aware=False) == brute(rows, False)


def test_a_crowded_place_is_shared_by_the_tasks(spark, monkeypatch):
    """All 44,850 pairs of 300 rows at one place came from one task when rows too many to be sent to all tasks met by their cell."""
    monkeypatch.setattr(dedup, "BLOCK", 16, raising=False)
    obs = spark.range(300).selectExpr("id as obs", "'a' as cls", "12.9D as lat", "80.3D as lon", "5.0D as unc")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = dedup.geographic_edges(obs).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in pairs) == 44850 and max(r["count"] for r in pairs) < 30000
