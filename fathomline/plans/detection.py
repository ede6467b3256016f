"""Queries on boxes: pairs, matching, suppression, tiles and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.boxes import area, from_centre
from fathomline.functions.numbers import micro
from fathomline.operators import matching as M
from fathomline.plans.registry import query
from fathomline.plans.views import AREA_A, BOXES, IOS, IOU, boxes, micro_sql, read

_MATCHED = f"""
WITH RECURSIVE {BOXES}, dets AS (
    SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, idx) AS k FROM boxes WHERE is_det
), truths AS (SELECT * FROM boxes WHERE NOT is_det), pairs AS (
    SELECT a.frame, a.k, b.idx AS t, {IOU} AS iou FROM dets a JOIN truths b ON a.frame = b.frame
), offers AS (
    SELECT d.frame, d.k, d.idx, list(p.t ORDER BY p.iou DESC, p.t) FILTER (WHERE p.t IS NOT NULL) AS offers
    FROM dets d LEFT JOIN pairs p ON p.frame = d.frame AND p.k = d.k AND p.iou >= 0.3 GROUP BY ALL
), step AS (
    SELECT frame, 0::BIGINT AS k, CAST([] AS DOUBLE[]) AS taken, CAST(NULL AS DOUBLE) AS det, CAST(NULL AS DOUBLE) AS truth FROM (SELECT DISTINCT frame FROM dets)
    UNION ALL
    SELECT frame, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, idx, pick
    FROM (SELECT o.frame, o.k, s.taken, o.idx, list_filter(o.offers, lambda t: NOT list_contains(s.taken, t))[1] AS pick FROM step s JOIN offers o ON o.frame = s.frame AND o.k = s.k + 1)
), matches AS (SELECT frame, det, truth FROM step WHERE truth IS NOT NULL)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    return b, b.filter("is_det"), b.filter("not is_det")


@query(
    _MATCHED
    + f""", counts AS (
    SELECT frame, count_if(NOT is_det) AS n_gt, count_if(is_det) AS n_det, any_value(coalesce(m.tp, 0)) AS tp
    FROM boxes LEFT JOIN (SELECT frame, count(*) AS tp FROM matches GROUP BY frame) m USING (frame) GROUP BY frame
), total AS (
    SELECT count(*) AS n_frames, count_if(n_gt > 0) AS n_frames_with_targets, count_if(n_gt = 0) AS n_frames_empty, sum(n_gt)::BIGINT AS n_gt_objects,
           sum(n_det)::BIGINT AS n_detections, sum(tp)::BIGINT AS tp, sum(n_det - tp)::BIGINT AS fp, sum(n_gt - tp)::BIGINT AS fn,
           count_if(n_gt = 0 AND n_det > 0) AS false_alarm_frames, sum(CASE WHEN n_gt = 0 THEN n_det ELSE 0 END) AS alarms FROM counts
), rates AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM total)
SELECT n_frames, n_frames_with_targets, n_frames_empty, n_gt_objects, n_detections, tp, fp, fn, false_alarm_frames, {micro_sql("p")} AS "precision", {micro_sql("r")} AS recall,
       {micro_sql("2 * p * r / (p + r)")} AS f1, {micro_sql("false_alarm_frames / n_frames_empty")} AS false_alarm_frame_rate, {micro_sql("alarms / n_frames_empty")} AS fp_per_empty_frame,
       n_frames_empty - false_alarm_frames AS frames_fully_clean FROM rates"""
)
def det_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN3, JN11, AG1, PRJ3: greedy matching of detections to truths and the survey's metrics."""
    frames, dets, truths = _sides(spark, sf_dir)
    counts = M.match_counts(frames, dets, truths, M.greedy_match(dets, truths, ["frame"]), ["frame"])
    rates = ("precision", "recall", "f1", "false_alarm_frame_rate", "fp_per_empty_frame")
    return M.survey_metrics(counts).withColumns({c: micro(F.col(c)) for c in rates})


@query(_MATCHED + " SELECT frame, det AS det_idx, truth AS truth_idx FROM matches")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: the pairs themselves."""
    _, dets, truths = _sides(spark, sf_dir)
    return M.greedy_match(dets, truths, ["frame"]).drop("iou")


def _pairs_sql(column: str, measure: str, least: float) -> str:
    return f"""WITH {BOXES} SELECT a.frame, a.idx AS det_idx, b.idx AS truth_idx, {micro_sql(measure)} AS {column}
        FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.is_det AND NOT b.is_det WHERE {measure} > {least}"""


@query(_pairs_sql("iou", IOU, 0.3))
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1: overlapping pairs by intersection over union."""
    _, dets, truths = _sides(spark, sf_dir)
    return M.pairwise(dets, truths, ["frame"]).filter("iou > 0.3").select("frame", F.col("a_idx").alias("det_idx"), F.col("b_idx").alias("truth_idx"), micro(F.col("iou")).alias("iou"))


@query(_pairs_sql("ios", IOS, 0.65))
def ios_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: pairs by intersection over the smaller box."""
    _, dets, truths = _sides(spark, sf_dir)
    return M.pairwise(dets, truths, ["frame"]).filter("ios > 0.65").select("frame", F.col("a_idx").alias("det_idx"), F.col("b_idx").alias("truth_idx"), micro(F.col("ios")).alias("ios"))


def _suppress_sql(keys: str, over: str) -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    join = " AND ".join(f"q.{k} = s.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE {BOXES}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, idx, x0, y0, x1, y1) AS k FROM boxes
    ), against AS (SELECT {", ".join("a." + k for k in keys.split(", "))}, a.k, list(b.k) AS against FROM ranked a JOIN ranked b ON {same} AND b.k < a.k AND ({over}) GROUP BY ALL
    ), queue AS (SELECT r.*, coalesce(x.against, []) AS against FROM ranked r LEFT JOIN against x USING ({keys}, k)
    ), step AS (
        SELECT {keys}, 1::BIGINT AS k, [1::BIGINT] AS kept FROM queue WHERE k = 1
        UNION ALL
        SELECT {", ".join("q." + k for k in keys.split(", "))}, q.k, CASE WHEN list_has_any(s.kept, q.against) THEN s.kept ELSE list_append(s.kept, q.k) END FROM step s JOIN queue q ON {join} AND q.k = s.k + 1
    ), last AS (SELECT {keys}, unnest(arg_max(kept, k)) AS k FROM step GROUP BY {keys})
    SELECT {", ".join("q." + k for k in keys.split(", "))}, q.idx FROM last s JOIN queue q ON {join} AND q.k = s.k"""


@query(_suppress_sql("frame", f"{IOU} > 0.5"))
def nms_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG20, WN8, SL11: non-maximum suppression in each frame."""
    return M.suppress(boxes(spark, sf_dir), ["frame"], 0.5)


@query(_suppress_sql("frame, cls", f"{IOU} > 0.45 OR {IOS} > 0.65"))
def tile_merge_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG21: merging of detections from overlapping tiles, class by class."""
    return M.suppress(boxes(spark, sf_dir), ["frame", "cls"], 0.45, 0.65)


_FRAMES = "frames AS (SELECT p_partkey AS frame, p_size * 40 AS width, p_size * 25 + 100 AS height FROM part)"
_TILES = f"""{_FRAMES}, grid AS (
        SELECT frame, width, height, unnest(range(greatest(ceil((height - 640) / 512), 0)::BIGINT + 1)) AS r, greatest(ceil((width - 640) / 512), 0)::BIGINT + 1 AS n FROM frames
    ), cells AS (SELECT *, unnest(range(n)) AS c FROM grid), tiles AS (
        SELECT frame, (r * n + c)::INTEGER AS idx, greatest(least(c * 512, width - 640), 0)::INTEGER AS x0, greatest(least(r * 512, height - 640), 0)::INTEGER AS y0, width, height FROM cells)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame"), (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 25 + 100).alias("height"))


@query(f"WITH {_TILES} SELECT frame, idx, x0, y0, least(x0 + 640, width)::INTEGER AS x1, least(y0 + 640, height)::INTEGER AS y1 FROM tiles")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG19: tiles of 640 with an overlap of 128."""
    return M.plan_tiles(_frames(spark, sf_dir), 640, 128)


@query(
    f"""WITH {_TILES} SELECT frame, idx AS tile, x0 + 10.5::DOUBLE AS x0, y0 + 20.5::DOUBLE AS y0, x0 + 60.0::DOUBLE AS x1, y0 + 70.0::DOUBLE AS y1 FROM tiles"""
)
def tile_to_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2: boxes of tiles in frame coordinates; here one fixed box in every tile."""
    tiles = M.plan_tiles(_frames(spark, sf_dir), 640, 128)
    local = tiles.select("frame", F.col("idx").alias("tile"), F.lit(10.5).alias("x0"), F.lit(20.5).alias("y0"), F.lit(60.0).alias("x1"), F.lit(70.0).alias("y1"))
    return M.to_global(local, tiles)


@query(
    f"""WITH {BOXES} SELECT frame, idx, {micro_sql("x1 - x0")} AS width, {micro_sql("y1 - y0")} AS height, {micro_sql(AREA_A)} AS area,
    {micro_sql("(x0 + x1) / 2")} AS cx, {micro_sql("(y0 + y1) / 2")} AS cy FROM boxes a"""
)
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3: sides, area and centre."""
    b = boxes(spark, sf_dir)
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return b.select("frame", "idx", micro(wide).alias("width"), micro(high).alias("height"), micro(area()).alias("area"), micro((F.col("x0") + F.col("x1")) / 2).alias("cx"), micro((F.col("y0") + F.col("y1")) / 2).alias("cy"))


@query(
    f"""WITH t AS (SELECT l_orderkey AS frame, l_extendedprice AS idx, l_discount * 5 AS cx, l_tax * 6 AS cy, l_quantity / 100 AS w, l_quantity / 200 AS h FROM lineitem)
    SELECT frame, idx, {micro_sql("(cx - w / 2) * 416")} AS x0, {micro_sql("(cy - h / 2) * 320")} AS y0, {micro_sql("(cx + w / 2) * 416")} AS x1, {micro_sql("(cy + h / 2) * 320")} AS y1 FROM t"""
)
def xywhn_to_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1: normalised centre boxes to corners on a frame of 416 by 320."""
    line = read(spark, sf_dir, "lineitem")
    corners = from_centre(F.col("l_discount") * 5, F.col("l_tax") * 6, F.col("l_quantity") / 100, F.col("l_quantity") / 200, F.lit(416), F.lit(320))
    return line.select(F.col("l_orderkey").alias("frame"), F.col("l_extendedprice").alias("idx"), *[micro(c).alias(n) for n, c in corners.items()])


@query(
    f"""WITH {BOXES}, cut AS (SELECT frame, idx, cls, greatest(x0, 10.0) AS x0, greatest(y0, 5.0) AS y0, least(x1, 60.0) AS x1, least(y1, 30.0) AS y1 FROM boxes)
    SELECT frame, idx, printf('%d %.6f %.6f %.6f %.6f', CASE cls WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, {micro_sql("((x0 + x1) / 2) / 64")}, {micro_sql("((y0 + y1) / 2) / 32")}, {micro_sql("(x1 - x0) / 64")}, {micro_sql("(y1 - y0) / 32")}) AS line
    FROM cut WHERE x1 - x0 > 0 AND y1 - y0 > 0"""
)
def yolo_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8, FLT5: label lines of boxes clipped to a window; boxes without area go."""
    b = boxes(spark, sf_dir)
    cut = b.select("frame", "idx", "cls", F.greatest("x0", F.lit(10.0)).alias("x0"), F.greatest("y0", F.lit(5.0)).alias("y0"), F.least("x1", F.lit(60.0)).alias("x1"), F.least("y1", F.lit(30.0)).alias("y1"))
    kept = cut.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    number = F.when(F.col("cls") == "A", 0).when(F.col("cls") == "N", 1).otherwise(2)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", number, micro((F.col("x0") + F.col("x1")) / 2 / 64), micro((F.col("y0") + F.col("y1")) / 2 / 32), micro((F.col("x1") - F.col("x0")) / 64), micro((F.col("y1") - F.col("y0")) / 32))
    return kept.select("frame", "idx", line.alias("line"))


@query(
    f"""WITH {BOXES} SELECT CASE WHEN a < 1000 THEN 'small' WHEN a < 2000 THEN 'medium' WHEN a < 3000 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS n,
    {micro_sql("avg(CASE WHEN is_det THEN 1.0 ELSE 0.0 END)")} AS recall, {micro_sql("quantile_cont(a, 0.5)")} AS median_area
    FROM (SELECT *, (x1 - x0) * (y1 - y0) AS a FROM boxes) GROUP BY 1"""
)
def size_bucket_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: share found by box area, and the median area."""
    a = F.col("a")
    bucket = F.when(a < 1000, "small").when(a < 2000, "medium").when(a < 3000, "large").otherwise("huge")
    sized = boxes(spark, sf_dir).withColumn("a", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return sized.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), micro(F.avg(F.col("is_det").cast("double"))).alias("recall"), micro(F.median("a")).alias("median_area"))


@query(
    f"""WITH {BOXES}, per AS (SELECT frame, count_if(NOT is_det) AS n, avg(CASE WHEN NOT is_det THEN (x1 - x0) * (y1 - y0) END) AS area FROM boxes GROUP BY frame),
    a AS (SELECT 'clear' AS scenario, frame, area FROM per WHERE n > 0 ORDER BY area DESC, frame LIMIT 6), b AS (SELECT 'hard' AS scenario, frame, area FROM per WHERE n > 0 ORDER BY area, frame LIMIT 6)
    SELECT scenario, frame, {micro_sql("area")} AS area FROM (FROM a UNION ALL FROM b)"""
)
def clear_hard_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL4: the frames with the largest and the smallest annotated targets."""
    per = boxes(spark, sf_dir).filter("not is_det").groupBy("frame").agg(F.avg((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    clear = per.orderBy(F.desc("area"), "frame").limit(6).select(F.lit("clear").alias("scenario"), "frame", "area")
    hard = per.orderBy("area", "frame").limit(6).select(F.lit("hard").alias("scenario"), "frame", "area")
    return clear.unionByName(hard).withColumn("area", micro(F.col("area")))


@query(f"WITH {BOXES} SELECT DISTINCT frame FROM boxes a WHERE is_det AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.frame = a.frame AND NOT b.is_det)")
def empty_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7, JN12, SO4: frames with detections and no truth."""
    _, dets, truths = _sides(spark, sf_dir)
    return dets.join(truths, "frame", "left_anti").select("frame").distinct()


@query(f"WITH {BOXES} SELECT DISTINCT frame FROM boxes WHERE is_det INTERSECT SELECT frame FROM boxes WHERE NOT is_det")
def target_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7, JN13, SO2: frames with both."""
    _, dets, truths = _sides(spark, sf_dir)
    return dets.select("frame").intersect(truths.select("frame"))


@query(
    f"""WITH {BOXES}, counts AS (SELECT frame, count_if(is_det) AS alarms, count_if(NOT is_det) AS truths FROM boxes GROUP BY frame)
    SELECT 'worst_empty' AS what, arg_max(frame, (alarms, -frame)) AS frame, max(alarms) AS n FROM counts WHERE truths = 0
    UNION ALL SELECT 'most_truths', arg_max(frame, (truths, -frame)), max(truths) FROM counts"""
)
def worst_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL5: the empty frame with most alarms and the frame with most truths."""
    counts = boxes(spark, sf_dir).groupBy("frame").agg(F.count_if(F.expr("is_det")).alias("alarms"), F.count_if(~F.col("is_det")).alias("truths"))

    def top(df: DataFrame, what: str, n: str) -> DataFrame:
        return df.agg(F.lit(what).alias("what"), F.max_by("frame", F.struct(n, -F.col("frame"))).alias("frame"), F.max(n).alias("n"))

    return top(counts.filter("truths = 0"), "worst_empty", "alarms").unionByName(top(counts, "most_truths", "truths"))


@query(
    f"""WITH {BOXES}, per AS (SELECT frame, count(*) FILTER (WHERE NOT is_det) AS n FROM boxes GROUP BY frame),
    k AS (SELECT frame, n > 0 AS target, row_number() OVER (PARTITION BY n > 0 ORDER BY frame) AS k FROM per) SELECT frame, target FROM k WHERE k <= 60"""
)
def stratified_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL6: the first 60 target frames and the first 60 empty ones by name."""
    per = boxes(spark, sf_dir).groupBy("frame").agg((F.count_if(~F.col("is_det")) > 0).alias("target"))
    # Two short sorted limits in place of a window over each stratum.
    return per.filter("target").orderBy("frame").limit(60).unionByName(per.filter("not target").orderBy("frame").limit(60))


@query(
    f"""WITH {BOXES} SELECT CASE WHEN frame % 4 = 0 THEN 'test' WHEN frame % 4 = 1 THEN 'val' ELSE 'train' END AS split, count(DISTINCT frame) AS frames,
    count(DISTINCT CASE WHEN NOT is_det THEN frame END) AS positive_frames, count(DISTINCT frame) - count(DISTINCT CASE WHEN NOT is_det THEN frame END) AS negative_frames,
    count_if(NOT is_det AND cls = 'A') AS objects_a, count_if(NOT is_det AND cls = 'N') AS objects_n, count_if(NOT is_det AND cls = 'R') AS objects_r FROM boxes GROUP BY 1"""
)
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, AG15, SL8: frames and labels of each split."""
    r = F.col("frame") % 4
    split = F.when(r == 0, "test").when(r == 1, "val").otherwise("train")
    per = boxes(spark, sf_dir).groupBy("frame").agg(*[F.count_if(~F.col("is_det") & (F.col("cls") == c)).alias(f"objects_{c.lower()}") for c in "ANR"], F.count_if(~F.col("is_det")).alias("n"))
    return per.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.expr("n > 0")).alias("positive_frames"), F.count_if(F.expr("n = 0")).alias("negative_frames"), *[F.sum(f"objects_{c}").alias(f"objects_{c}") for c in "anr"]
    )


@query(
    f"""WITH {BOXES}, grid AS (SELECT v.variant, v.least, b.* FROM boxes b CROSS JOIN (VALUES ('all', 0.0), ('cut', 0.3), ('strict', 0.6)) v(variant, least)),
    per AS (SELECT variant, frame, count_if(NOT is_det) AS n_gt, count_if(is_det AND score >= least) AS n_det FROM grid GROUP BY ALL)
    SELECT variant, count(*) AS frames, sum(n_gt)::BIGINT AS n_gt, sum(n_det)::BIGINT AS n_det, count_if(n_gt = 0 AND n_det > 0) AS false_alarm_frames,
           {micro_sql("sum(n_det) / (SELECT sum(n_det) FROM per WHERE variant = 'all')")} AS retained FROM per GROUP BY variant"""
)
def ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, PL4, PL5, WN10, FLT4: variants of a score cut over all frames, against the first."""
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(t).alias("least")) for n, t in (("all", 0.0), ("cut", 0.3), ("strict", 0.6))])
    grid = boxes(spark, sf_dir).select("*", F.inline(variants))
    per = grid.groupBy("variant", "frame").agg(F.count_if(~F.col("is_det")).alias("n_gt"), F.count_if(F.col("is_det") & (F.col("score") >= F.col("least"))).alias("n_det"))
    total = per.groupBy("variant").agg(F.count(F.lit(1)).alias("frames"), F.sum("n_gt").alias("n_gt"), F.sum("n_det").alias("n_det"), F.count_if(F.expr("n_gt = 0 and n_det > 0")).alias("false_alarm_frames"))
    first = total.filter("variant = 'all'").select(F.col("n_det").alias("_base"))
    return total.crossJoin(F.broadcast(first)).withColumn("retained", micro(F.col("n_det") / F.col("_base"))).drop("_base")  # one row


@query(
    f"""WITH {BOXES} SELECT count_if(x1 <= x0) AS no_width, count_if(y1 <= y0) AS no_height, count_if(x0 < 0 OR x1 > 100) AS outside, count_if(cls NOT IN ('A', 'N')) AS bad_class,
    count_if(score < 0 OR score > 1) AS bad_score, count(*) AS checked FROM boxes"""
)
def label_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ2: how many labels break each rule."""
    return boxes(spark, sf_dir).agg(
        F.count_if(F.expr("x1 <= x0")).alias("no_width"), F.count_if(F.expr("y1 <= y0")).alias("no_height"), F.count_if(F.expr("x0 < 0 or x1 > 100")).alias("outside"),
        F.count_if(F.expr("cls not in ('A', 'N')")).alias("bad_class"), F.count_if(F.expr("score < 0 or score > 1")).alias("bad_score"), F.count(F.lit(1)).alias("checked"),
    )


@query("SELECT o_orderkey AS frame FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def frames_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ1, FLT9: frames whose label file is missing."""
    frames = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    return frames.join(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame")), "frame", "left_anti")


@query(
    f"""WITH {BOXES}, f AS (SELECT CASE WHEN frame % 4 = 0 THEN 'test' WHEN frame % 4 = 1 THEN 'val' ELSE 'train' END AS split, frame, idx, (x1 - x0) * (y1 - y0) / 6400 AS share FROM boxes WHERE NOT is_det),
    r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY share DESC, frame, idx) AS k FROM f), m AS (SELECT split, max(share) AS top, median(share) AS mid FROM f GROUP BY split)
    SELECT split, k, frame, {micro_sql("share")} AS share, {micro_sql("top")} AS largest, {micro_sql("mid")} AS median_share FROM r JOIN m USING (split) WHERE k <= 5"""
)
def area_fraction_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13: the largest targets of each split as shares of the frame, with the split's median."""
    r = F.col("frame") % 4
    split = F.when(r == 0, "test").when(r == 1, "val").otherwise("train")
    f = boxes(spark, sf_dir).filter("not is_det").select(split.alias("split"), "frame", "idx", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / 6400).alias("share"))
    # Three small sorted limits in place of a window over each split.
    tops = [f.filter(F.col("split") == s).orderBy(F.desc("share"), "frame", "idx").limit(5) for s in ("test", "val", "train")]
    five = tops[0].unionByName(tops[1]).unionByName(tops[2])
    ranked = five.groupBy("split").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), "frame", "idx"))).alias("t")).select("split", F.posexplode("t").alias("k", "t"))
    stats = f.groupBy("split").agg(F.max("share").alias("top"), F.median("share").alias("mid"))
    return ranked.join(stats, "split").select("split", (F.col("k") + 1).cast("long").alias("k"), F.col("t.frame").alias("frame"), micro(-F.col("t.o")).alias("share"), micro(F.col("top")).alias("largest"), micro(F.col("mid")).alias("median_share"))


@query(_MATCHED + " SELECT b.frame, b.idx, (m.truth IS NOT NULL)::INTEGER AS label, b.score FROM boxes b LEFT JOIN matches m ON m.frame = b.frame AND m.det = b.idx WHERE b.is_det")
def candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL3: every detection with whether it is true, for fitting the filter."""
    _, dets, truths = _sides(spark, sf_dir)
    found = M.greedy_match(dets, truths, ["frame"]).select("frame", F.col("det_idx").alias("idx"), F.lit(1).alias("label"))
    return dets.join(found, ["frame", "idx"], "left").select("frame", "idx", F.coalesce("label", F.lit(0)).alias("label"), "score")


@query(
    _MATCHED
    + f""", sides AS (SELECT b.*, CASE WHEN cls = 'A' THEN 'raw' ELSE 'preprocessed' END AS trained_on, CASE WHEN x0 < 25 THEN 'raw' ELSE 'preprocessed' END AS inference_on FROM boxes b),
    cells AS (SELECT trained_on, inference_on, count_if(NOT is_det) AS n_gt, count_if(is_det) AS n_det, count(m.truth) AS tp FROM sides s LEFT JOIN matches m ON s.is_det AND m.frame = s.frame AND m.det = s.idx GROUP BY ALL),
    f AS (SELECT *, 2 * tp / (n_gt + n_det) AS f1 FROM cells),
    o AS (SELECT max(f1) FILTER (WHERE trained_on = 'raw' AND inference_on = 'raw') AS r, max(f1) FILTER (WHERE trained_on = 'preprocessed' AND inference_on = 'preprocessed') AS p,
        max(f1) FILTER (WHERE trained_on = 'raw' AND inference_on = 'preprocessed') AS m FROM f)
    SELECT {micro_sql("r")} AS raw_f1, {micro_sql("p")} AS preprocessed_f1, {micro_sql("m")} AS mismatched_f1, CASE WHEN p > r THEN 'preprocessing' ELSE 'raw imagery' END AS better FROM o"""
)
def better_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN13: which of the matched cells of training and inference is better; class and place stand for the two."""
    every, dets, truths = _sides(spark, sf_dir)
    found = M.greedy_match(dets, truths, ["frame"]).select("frame", F.col("det_idx").alias("idx"), F.lit(True).alias("is_det"), F.lit(1).alias("hit"))
    trained, inferred = F.when(F.col("cls") == "A", "raw").otherwise("preprocessed"), F.when(F.col("x0") < 25, "raw").otherwise("preprocessed")
    cells = every.join(found, ["frame", "idx", "is_det"], "left").groupBy(trained.alias("trained_on"), inferred.alias("inference_on"))
    counted = cells.agg(F.count_if(~F.col("is_det")).alias("n_gt"), F.count_if("is_det").alias("n_det"), F.count("hit").alias("tp"))
    return M.better_cell(counted).withColumns({c: micro(F.col(c)) for c in ("raw_f1", "preprocessed_f1", "mismatched_f1")})


@query(
    f"""WITH {BOXES}, d AS (SELECT cls, floor(score * 100) AS score, (floor(idx)::BIGINT % 3 > 0)::INTEGER AS tp FROM boxes WHERE is_det), t AS (SELECT cls, count(*) AS n_gt FROM boxes GROUP BY cls),
    c AS (SELECT cls, score, sum(tp) AS t, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT *, sum(t) OVER w / sum(n) OVER w AS precision FROM c WINDOW w AS (PARTITION BY cls ORDER BY score DESC)),
    e AS (SELECT *, max(precision) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM p)
    SELECT cls, any_value(n_gt) AS n_gt, sum(n)::BIGINT AS n_det, {micro_sql("sum(t * best) / any_value(n_gt)")} AS ap FROM e JOIN t USING (cls) GROUP BY cls"""
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25: area under the precision envelope of each class, for detections whose hits are given."""
    b = boxes(spark, sf_dir)
    found = b.filter("is_det").select("cls", F.floor(F.col("score") * 100).alias("score"), (F.floor("idx") % 3 > 0).cast("int").alias("tp"))
    totals = b.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    return M.average_precision(found, totals, ["cls"]).withColumn("ap", micro(F.col("ap")))


_MEAN_PRECISION = f"""
WITH RECURSIVE {BOXES}, levels AS (SELECT unnest([{", ".join(map(repr, M.LEVELS))}])::DOUBLE AS level), dets AS (
    SELECT b.*, row_number() OVER (PARTITION BY cls, frame ORDER BY score DESC, idx) AS k FROM boxes b WHERE is_det
), truths AS (SELECT * FROM boxes WHERE NOT is_det), pairs AS (
    SELECT a.cls, a.frame, a.k, b.idx AS t, {IOU} AS iou FROM dets a JOIN truths b ON a.frame = b.frame AND a.cls = b.cls
), offers AS (
    SELECT level, d.cls, d.frame, d.k, d.score, list(p.t ORDER BY p.iou DESC, p.t) FILTER (WHERE p.t IS NOT NULL) AS offers
    FROM dets d CROSS JOIN levels LEFT JOIN pairs p ON p.cls = d.cls AND p.frame = d.frame AND p.k = d.k AND p.iou >= level GROUP BY ALL
), step AS (
    SELECT level, cls, frame, 0::BIGINT AS k, CAST([] AS DOUBLE[]) AS taken, CAST(NULL AS DOUBLE) AS score, 0 AS tp FROM (SELECT DISTINCT level, cls, frame FROM offers)
    UNION ALL
    SELECT level, cls, frame, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, score, CASE WHEN pick IS NULL THEN 0 ELSE 1 END
    FROM (SELECT o.level, o.cls, o.frame, o.k, s.taken, o.score, list_filter(o.offers, lambda t: NOT list_contains(s.taken, t))[1] AS pick FROM step s JOIN offers o ON o.level = s.level AND o.cls = s.cls AND o.frame = s.frame AND o.k = s.k + 1)
), c AS (SELECT cls, level, score, sum(tp) AS t, count(*) AS n FROM step WHERE k > 0 GROUP BY ALL
), p AS (SELECT *, sum(t) OVER w / sum(n) OVER w AS precision FROM c WINDOW w AS (PARTITION BY cls, level ORDER BY score DESC)
), e AS (SELECT *, max(precision) OVER (PARTITION BY cls, level ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM p
), a AS (SELECT cls, level, sum(t * best) / any_value(n_gt) AS ap FROM e JOIN (SELECT cls, count(*) AS n_gt FROM truths GROUP BY cls) USING (cls) GROUP BY ALL
), per AS (SELECT cls, max(ap) FILTER (WHERE level = 0.5) AS ap50, avg(ap) AS ap50_95 FROM a GROUP BY cls)
SELECT cls, {micro_sql("ap50")} AS ap50, {micro_sql("ap50_95")} AS ap50_95 FROM per UNION ALL SELECT NULL, {micro_sql("avg(ap50)")}, {micro_sql("avg(ap50_95)")} FROM per"""


@query(_MEAN_PRECISION)
def mean_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25: precision at ten overlaps of every class and their mean, from boxes to areas."""
    b = boxes(spark, sf_dir)
    out = M.mean_precision(b.filter("is_det"), b.filter("not is_det"))
    return out.select("cls", micro(F.col("ap50")).alias("ap50"), micro(F.col("ap50_95")).alias("ap50_95"))
