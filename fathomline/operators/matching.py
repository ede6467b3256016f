"""Pairing and suppression of boxes within frames.

The order-dependent loops are folds over one frame's score-sorted array, so
they stay inside the JVM; frames are the unit of distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.boxes import ios, iou
from fathomline.functions.numbers import ratio
from fathomline.session import saved

BOX = ("x0", "y0", "x1", "y1")


def _side(df: DataFrame, keys: list[str], prefix: str, *more: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in ("idx", *BOX, *more)])


def pairwise(left: DataFrame, right: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Every pair of a left and a right box of one frame (``a_``, ``b_`` columns) with its ``iou`` and ``ios``."""
    pairs = _side(left, keys, "a_", *more).join(_side(right, keys, "b_", *more), keys)
    return pairs.withColumn("iou", iou("a_", "b_")).withColumn("ios", ios("a_", "b_"))


def greedy_match(dets: DataFrame, truths: DataFrame, keys: list[str], threshold: float = 0.3, class_aware: bool = False) -> DataFrame:
    """``keys, det_idx, truth_idx, iou``: detections in falling score order each take the free truth of highest IoU.

    A truth is taken only from ``threshold`` on; equal overlaps go to the
    lowest truth, equal scores to the lowest detection first.
    """
    pairs = _scored_pairs(dets, truths, keys).filter(F.col("iou") >= threshold)
    if class_aware:
        pairs = pairs.filter("a_cls = b_cls")
    return _taken(pairs, keys).drop("score")


def _scored_pairs(dets: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    pairs = _side(dets, keys, "a_", "cls", "score").join(_side(truths, keys, "b_", "cls"), keys)
    return pairs.withColumn("iou", iou("a_", "b_"))


def _taken(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The greedy choice among pairs (``a_idx, a_score, b_idx, iou``) inside each of ``keys``; a detection without a pair takes nothing anyhow."""
    offers = pairs.groupBy(*keys, "a_idx", "a_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), F.col("b_idx").alias("t")))).alias("offers"))
    frames = offers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("a_score")).alias("s"), F.col("a_idx").alias("idx"), "offers"))).alias("queue"))
    det, truth, score = (pairs.schema[c].dataType.simpleString() for c in ("a_idx", "b_idx", "a_score"))
    empty = F.array().cast(f"array<struct<det_idx:{det},truth_idx:{truth},iou:double,score:{score}>>")

    def step(state: Column, det: Column) -> Column:
        free = F.filter(det["offers"], lambda o: ~F.array_contains(state["truth_idx"], o["t"]))
        pick = F.get(free, F.lit(0))
        made = F.struct(det["idx"].alias("det_idx"), pick["t"].alias("truth_idx"), (-pick["o"]).alias("iou"), (-det["s"]).alias("score"))
        return F.when(F.size(free) > 0, F.concat(state, F.array(made))).otherwise(state)

    return frames.select(*keys, F.inline(F.aggregate("queue", empty, step)))


def match_counts(frames: DataFrame, dets: DataFrame, truths: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_gt, n_det, tp, fp, fn`` for every frame, those without boxes included."""
    n_det = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_det"))
    n_gt = truths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    tp = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("tp"))
    counted = frames.select(*keys).distinct().join(n_gt, keys, "left").join(n_det, keys, "left").join(tp, keys, "left").na.fill(0, ["n_gt", "n_det", "tp"])
    return counted.withColumn("fp", F.col("n_det") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))


def survey_metrics(counts: DataFrame, *by: str) -> DataFrame:
    """Counts of frames and objects, precision, recall, F1 and the false-alarm figures of frames without truths."""
    empty = F.col("n_gt") == 0
    total = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(~empty).alias("n_frames_with_targets"),
        F.count_if(empty).alias("n_frames_empty"),
        F.sum("n_gt").alias("n_gt_objects"),
        F.sum("n_det").alias("n_detections"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"),
        F.count_if(empty & (F.col("n_det") > 0)).alias("false_alarm_frames"),
        F.coalesce(F.sum(F.when(empty, F.col("n_det"))), F.lit(0)).alias("_alarms"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    named = total.withColumn("precision", p).withColumn("recall", r)
    return (
        named.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("false_alarm_frame_rate", ratio(F.col("false_alarm_frames"), F.col("n_frames_empty")))
        .withColumn("fp_per_empty_frame", ratio(F.col("_alarms"), F.col("n_frames_empty")))
        .withColumn("frames_fully_clean", F.col("n_frames_empty") - F.col("false_alarm_frames"))
        .drop("_alarms")
    )


def suppress(boxes: DataFrame, keys: list[str], iou_over: float, ios_over: float | None = None) -> DataFrame:
    """``keys, idx`` of the boxes that stay: in falling score order, one that overlaps a kept one too much goes.

    Too much is an IoU over ``iou_over`` or, where given, an intersection over
    the smaller box above ``ios_over``. Boxes of different ``keys`` never meet,
    so a class in ``keys`` makes the suppression class-wise. Equal scores go by
    ``idx``, and boxes of one ``idx``, which are boxes of their own, by their corners.
    """
    order = Window.partitionBy(*keys).orderBy((-F.col("score")).asc_nulls_last(), "idx", "x0", "y0", "x1", "y1")
    ranked = boxes.withColumn("shown", F.col("idx")).withColumn("idx", F.row_number().over(order))
    pairs = pairwise(ranked, ranked, keys).filter("b_idx < a_idx")
    over = F.col("iou") > iou_over
    pairs = pairs.filter(over if ios_over is None else over | (F.col("ios") > ios_over))
    against = pairs.groupBy(*keys, F.col("a_idx").alias("idx")).agg(F.collect_list("b_idx").alias("against"))
    queued = ranked.select(*keys, "idx", "shown").join(against, [*keys, "idx"], "left")
    frames = queued.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "shown", "against"))).alias("queue"))

    def step(kept: Column, box: Column) -> Column:
        clear = ~F.coalesce(F.arrays_overlap(kept, box["against"]), F.lit(False))
        return F.when(clear, F.concat(kept, F.array(box["idx"]))).otherwise(kept)

    stay = frames.select(*keys, "queue", F.explode(F.aggregate("queue", F.array().cast("array<int>"), step)).alias("at"))
    return stay.select(*keys, F.get("queue", F.col("at") - 1)["shown"].alias("idx"))


def plan_tiles(frames: DataFrame, size: int, overlap: int) -> DataFrame:
    """``frame, idx, x0, y0, x1, y1`` of the tiles that cover frames of columns ``frame, width, height``.

    Tiles are ``size`` wide and high and overlap by ``overlap``; those at the
    far edges are moved inwards, and a frame that fits is one tile.
    """
    if overlap >= size:
        raise ValueError(f"overlap {overlap} must be smaller than the tile size {size}")
    step = size - overlap

    def starts(extent: str) -> Column:
        last = F.greatest(F.ceil((F.col(extent) - size) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.greatest(F.least(k * step, F.col(extent).cast("int") - size), F.lit(0)))

    rows = frames.withColumn("columns", starts("width")).select("*", F.posexplode(starts("height")).alias("r", "y0"))
    tiles = rows.select("frame", "width", "height", "y0", "r", F.size("columns").alias("n"), F.posexplode("columns").alias("c", "x0"))
    return tiles.select("frame", (F.col("r") * F.col("n") + F.col("c")).alias("idx"), "x0", "y0", F.least(F.col("x0") + size, "width").alias("x1"), F.least(F.col("y0") + size, "height").alias("y1"))


def to_global(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile-local boxes (``frame, tile``, box) moved by their tile's corner."""
    corner = tiles.select("frame", F.col("idx").alias("tile"), F.col("x0").alias("_dx"), F.col("y0").alias("_dy"))
    moved = boxes.join(corner, ["frame", "tile"])
    return moved.withColumns({"x0": F.col("x0") + F.col("_dx"), "x1": F.col("x1") + F.col("_dx"), "y0": F.col("y0") + F.col("_dy"), "y1": F.col("y1") + F.col("_dy")}).drop("_dx", "_dy")


def better_cell(cells: DataFrame) -> DataFrame:
    """One row: the F1 of the two cells whose model saw its own kind of frames, of the raw model on conditioned ones, and which of the first two is better.

    ``cells`` has ``trained_on, inference_on`` ("raw" or "preprocessed") and
    ``n_gt, n_det, tp``. Equal cells count for raw imagery; a missing cell is null.
    """
    f1 = F.when(F.col("n_gt") + F.col("n_det") > 0, 2 * F.col("tp") / (F.col("n_gt") + F.col("n_det"))).otherwise(F.lit(0.0))
    of = lambda a, b: F.max(F.when((F.col("trained_on") == a) & (F.col("inference_on") == b), f1))
    found = cells.agg(of("raw", "raw").alias("raw_f1"), of("preprocessed", "preprocessed").alias("preprocessed_f1"), of("raw", "preprocessed").alias("mismatched_f1"))
    return found.withColumn("better", F.when(F.col("preprocessed_f1") > F.col("raw_f1"), "preprocessing").otherwise("raw imagery"))


#: Overlaps at which mean precision is taken.
LEVELS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


def average_precision(flagged: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_gt, n_det, ap``: the area under the precision envelope of detections (``keys, score, tp`` 0 or 1) against ``totals`` (``keys, n_gt``).

    Detections enter by falling score, those of one score together. After each
    score there is a recall and a precision; the envelope at a recall is the
    best precision at it or any higher one, and each step of recall counts with
    the envelope there. A class without truths has a null ``ap``, one that
    nothing was found for 0.

    Sums run over counts per distinct score, dealt by ranges of keys and score;
    each range adds what the ranges before it hold, and takes the best of those
    behind it, so no task sees all detections of a class.
    """
    cells = flagged.groupBy(*keys, "score").agg(F.sum("tp").cast("long").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return _area_of(cells, totals, keys, ["_t"]).withColumnRenamed("_t", "ap")


def _area_of(cells: DataFrame, totals: DataFrame, keys: list[str], hits: list[str]) -> DataFrame:
    """``average_precision`` from detections (``_n``) and one or several columns of hits of each score (``keys, score, _n``); each column of hits becomes its area."""
    cells = cells.withColumn("_down", -F.col("score"))
    ranged = saved(cells.repartitionByRange(*keys, "_down").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy("_down")
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"{c}0") for c in ("_n", *hits)])
    starts = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"{c}0").over(ahead), F.lit(0)).alias(f"{c}0") for c in ("_n", *hits)])
    upto = ranged.join(starts, [*keys, "_part"]).withColumns({f"{c}+": F.col(f"{c}0") + F.sum(c).over(inside) for c in ("_n", *hits)})
    curve = upto.select(*keys, "_part", "_down", "_n", *hits, *[(F.col(f"{c}+") / F.col("_n+")).alias(f"{c}p") for c in hits])
    later = curve.groupBy(*keys, "_part").agg(*[F.max(f"{c}p").alias(f"{c}b") for c in hits]).select(*keys, "_part", *[F.max(f"{c}b").over(behind).alias(f"{c}l") for c in hits])
    # From the far end on: a frame that only loses rows would be gone through anew for each of them.
    rest = Window.partitionBy(*keys, "_part").orderBy(F.desc("_down")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    envelope = {f"{c}e": F.greatest(F.max(f"{c}p").over(rest), F.coalesce(f"{c}l", F.lit(0.0))) for c in hits}
    area = curve.join(later, [*keys, "_part"]).withColumns(envelope).groupBy(*keys).agg(F.sum("_n").alias("n_det"), *[F.sum(F.col(c) * F.col(f"{c}e")).alias(c) for c in hits])
    out = totals.join(area, keys, "left")
    return out.select(*keys, "n_gt", F.coalesce("n_det", F.lit(0)).alias("n_det"), *[F.when(F.col("n_gt") > 0, F.coalesce(c, F.lit(0.0)) / F.col("n_gt")).alias(c) for c in hits])


def mean_precision(dets: DataFrame, truths: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """``cls, ap50, ap50_95`` of every class of ``truths`` (``frame, idx, cls``, corners; detections with ``score``), and of all as class null: their means.

    At each overlap detections take truths of their class and frame greedily by
    falling score; ``ap50`` is that of the first level. Boxes are paired once,
    and a pair goes to all levels that it reaches. A score is one row with its
    hits at all levels, so the curves are as long as the scores, not ten times.
    """
    wanted = F.array(*map(F.lit, levels))
    pairs = _scored_pairs(dets.withColumn("kind", F.col("cls")), truths.withColumn("kind", F.col("cls")), ["kind", "frame"]).filter(F.col("iou") >= min(levels))
    hits = _taken(pairs.withColumn("level", F.explode(F.filter(wanted, lambda v: F.col("iou") >= v))), ["level", "kind", "frame"])
    names = [f"_t{k}" for k in range(len(levels))]
    hits = hits.groupBy(F.col("kind").alias("cls"), "score").agg(*[F.count_if(F.col("level") == v).alias(c) for c, v in zip(names, levels, strict=True)])
    seen = dets.groupBy("cls", "score").agg(F.count(F.lit(1)).alias("_n"))
    cells = seen.join(hits, ["cls", "score"], "left").na.fill(0, names)
    totals = truths.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    mean = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
    per = _area_of(cells, totals, ["cls"], names).select("cls", F.col(names[0]).alias("ap50"), mean.alias("ap50_95"))
    return per.unionByName(per.agg(F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95")).withColumn("cls", F.lit(None).cast(truths.schema["cls"].dataType)))
