"""Steps that must not grow faster than their input, and results that must not depend on its size."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import dedup, navigation
from fathomline.plans import register
from fathomline.plans.geo import _at_rows


def test_image_rows_are_not_sent_through_the_driver(spark, sf_dir):
    plan = _at_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("SortMergeJoin") == 2


def test_image_rows_at_the_last_fix(spark):
    nav = spark.createDataFrame([(1, 0, 0.0, 10.0, 350.0, 4.0), (1, 1, 2.0, 20.0, 10.0, None), (2, 0, 5.0, 6.0, 7.0, None)], "track long, nav_idx int, lat double, lon double, heading double, altitude double")
    rows = nav.select("track").distinct().withColumn("row", F.explode(F.array(*map(F.lit, range(3)))))
    got = {(r.track, r.row): (r.lat, r.lon, r.heading, r.altitude) for r in navigation.at_rows(rows, nav, 3).collect()}
    assert got == {(1, 0): (0, 10, 350, 4), (1, 1): (1, 15, 0, 4), (1, 2): (2, 20, 10, None), **{(2, k): (5, 6, 7, None) for k in range(3)}}


@pytest.mark.parametrize("query, frames", [("hazard_numbering", False), ("topk_priority", False), ("survey_summary", False), ("hazard_register", True), ("hazard_flat_csv", True)])
def test_hazards_bring_only_what_is_asked_for(spark, sf_dir, monkeypatch, query, frames):
    written, keep = set(), dedup.saved
    monkeypatch.setattr(dedup, "saved", lambda df: written.update(df.columns) or keep(df))
    plan = getattr(register, query)(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "cluster" in written and not {"frames", "spread_m"} & written
    assert "ASIN(" not in plan  # no member is held against its hazard's centre
    assert ("collect_list(frame_index" in plan) == frames


def test_spread_and_frames_of_a_hazard_where_they_are_asked_for(spark):
    rows = [(1.0, 7, 10.0, 20.0), (2.0, 5, 10.0, 20.0001), (3.0, 7, 10.0, 20.0), (9.0, None, None, None)]
    obs = spark.createDataFrame(rows, "obs double, frame_index long, lat double, lon double").selectExpr("*", "'A' as cls", "1.0D as unc", "0.5D as confidence", "0D as x0", "0D as y0", "1D as x1", "1D as y1", "if(obs < 9, 1.0D, 9.0D) as cluster")
    got = {r.cluster: (r.observation_count, r.frames, r.spread_m) for r in dedup.rollup_members(obs).collect()}
    assert got[1.0][:2] == (3, [5, 7]) and 5 < got[1.0][2] < 10
    assert got[9.0] == (1, [], None)
