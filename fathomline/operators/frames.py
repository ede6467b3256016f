"""Operators on frames whose pixels are rows ``frame, ping, bin, v`` with ``v`` from 0 to 1.

Everything is grouped by frame at least, so frames spread over the cluster.
Quality control, conditioning and evidence are in ``fathomline.operators.images``,
where a frame is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numbers import clip


def to_unit(p: DataFrame) -> DataFrame:
    """Values of frames that go beyond 1.5 are taken as 0 to 255; all are clipped to 0 to 1."""
    top = F.max("v").over(Window.partitionBy("frame"))
    return p.withColumn("v", clip(F.when(top > 1.5, F.col("v") / 255).otherwise(F.col("v")), 0.0, 1.0))


def shapes(p: DataFrame) -> DataFrame:
    return p.groupBy("frame").agg((F.max("ping") + 1).alias("height"), (F.max("bin") + 1).alias("width"))


def quality_score(dynamic_range: Column, dropout: Column, saturated: Column, speckle: Column, usable: Column) -> Column:
    """0 to 1: five shares, weighted; an unknown speckle counts as one half."""
    spk = F.when(speckle.isNull() | F.isnan(speckle), 0.5).otherwise(1 - clip((speckle - 0.15) / 0.55, 0.0, 1.0))
    parts = (clip(dynamic_range / 0.6, 0.0, 1.0), 1 - clip(dropout / 0.20, 0.0, 1.0), 1 - clip(saturated / 0.30, 0.0, 1.0), spk, clip(usable, 0.0, 1.0))
    return clip(reduce(lambda a, b: a + b, [w * p for w, p in zip((0.25, 0.25, 0.15, 0.20, 0.15), parts, strict=True)]), 0.0, 1.0)


def quality_notes(band: Column) -> Column:
    """What an operator should know of a frame, from its quality columns and its band's share of the width. Fixed values of the report."""
    share = lambda x: F.concat(F.format_number(100 * x, 1), F.lit("%"))
    return F.array_compact(
        F.array(
            F.when(F.col("dynamic_range") < 0.15, "Very low dynamic range - contrast normalisation strongly recommended."),
            F.when(F.col("dropout_ratio") > 0.05, F.concat(share(F.col("dropout_ratio")), F.lit(" of ping rows are dead (probable data dropout)."))),
            F.when(F.col("saturated_ratio") > 0.25, F.concat(share(F.col("saturated_ratio")), F.lit(" of pixels are clipped at black/white."))),
            F.when(F.col("speckle_index") > 0.5, "High speckle index - denoising recommended before detection."),
            F.when(F.col("band_start").isNull(), "No water-column band detected (image may already be nadir-removed or georectified).").otherwise(
                F.concat(F.lit("Water column detected at columns "), F.col("band_start").cast("string"), F.lit("-"), F.col("band_end").cast("string"), F.lit(" ("), share(band), F.lit(" of swath width)."))
            ),
            F.when(F.col("unique_levels") < 32, F.concat(F.lit("Only "), F.col("unique_levels").cast("string"), F.lit(" distinct intensity levels - possible over-quantisation."))),
        )
    )


def patches(p: DataFrame, size: int, step: int) -> DataFrame:
    """``frame, py, px`` and the pixels of whole square patches at every ``step``; a pixel is in all patches over it."""
    sized = p.join(shapes(p), "frame")

    def starts(c: str, extent: str) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / step)).cast("int")
        high = F.least(F.floor(F.col(c) / step), F.floor((F.col(extent) - size) / step)).cast("int")
        return F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * step)).otherwise(F.array().cast("array<int>"))

    return sized.withColumn("py", F.explode(starts("ping", "height"))).withColumn("px", F.explode(starts("bin", "width"))).select("frame", "py", "px", "ping", "bin", "v")


def target_stats(p: DataFrame, boxes: DataFrame, pad: int = 20) -> DataFrame:
    """``frame, n, area, contrast``: how many boxes each frame has, their mean share of it, and how far their peaks stand above their surroundings.

    Corners are cut to whole pixels of the frame; a box without pixels counts
    in ``n`` only. Frames without boxes get zeros. A frame's pixels meet its
    boxes by one equi-join cut to each box's surroundings.
    """
    size = shapes(p)
    b = boxes.select("frame", "idx", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]).join(size, "frame")
    b = b.withColumn("x0", F.greatest("x0", F.lit(0))).withColumn("y0", F.greatest("y0", F.lit(0))).withColumn("x1", F.least("x1", "width")).withColumn("y1", F.least("y1", "height"))
    whole = b.filter("x1 > x0 and y1 > y0")
    near = p.join(whole, "frame").filter((F.col("bin") >= F.col("x0") - pad) & (F.col("bin") < F.col("x1") + pad) & (F.col("ping") >= F.col("y0") - pad) & (F.col("ping") < F.col("y1") + pad))
    inside = F.expr("bin >= x0 and bin < x1 and ping >= y0 and ping < y1")
    each = near.groupBy("frame", "idx", "x0", "y0", "x1", "y1", "width", "height").agg((F.max(F.when(inside, F.col("v"))) - F.avg("v")).alias("contrast"))
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("height") * F.col("width"))
    means = each.groupBy("frame").agg(F.avg(share).alias("area"), F.avg("contrast").alias("contrast"))
    counted = size.select("frame").join(b.groupBy("frame").agg(F.count(F.lit(1)).alias("n")), "frame", "left").join(means, "frame", "left")
    return counted.select("frame", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("contrast", F.lit(0.0)).alias("contrast"))


def replicate(p: DataFrame, channels: int = 3) -> DataFrame:
    """Pixels with ``v`` repeated over ``channels``: grey stays grey, as a colour map would invent structure."""
    return p.withColumn("v", F.array_repeat("v", channels))
