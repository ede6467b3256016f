"""Queries on sonar frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import raster as R
from fathomline.functions.confidence import LinearFilter, Platt
from fathomline.functions.numbers import micro
from fathomline.operators import frames as K
from fathomline.operators import images as I
from fathomline.operators.calibration import roc_auc
from fathomline.plans.registry import query
from fathomline.plans.views import PINGS, frame_arrays, micro_sql, pings


def _dead_sql(src: str, key: str = "") -> str:
    return f"""rowstat{key} AS (SELECT frame, ping, max(v) - min(v) AS spread, avg(v) AS mean FROM {src} GROUP BY ALL), med{key} AS (SELECT frame, median(mean) AS med FROM rowstat{key} GROUP BY frame),
mad{key} AS (SELECT frame, any_value(med) AS med, median(abs(mean - med)) AS mad FROM rowstat{key} JOIN med{key} USING (frame) GROUP BY frame),
dead{key} AS (SELECT frame, ping, spread < 1e-3 OR (mad > 1e-6 AND mean < med - 4 * 1.4826 * mad) AS dead FROM rowstat{key} JOIN mad{key} USING (frame))"""


def _band_sql(src: str) -> str:
    return f"""col AS (SELECT frame, bin, avg(v) AS m FROM {src} GROUP BY ALL), sm AS (SELECT frame, bin, sum(m) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM col),
smed AS (SELECT frame, median(s) AS med FROM sm GROUP BY frame), dark AS (SELECT frame, bin, bin - lag(bin) OVER (PARTITION BY frame ORDER BY bin) AS gap FROM sm JOIN smed USING (frame) WHERE med > 1e-6 AND s < 0.55 * med),
isl AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY bin) AS run FROM dark), runs AS (SELECT frame, run, min(bin) AS a, max(bin) + 1 AS b FROM isl GROUP BY ALL),
pick AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY CASE WHEN a <= 32 AND 32 < b THEN 0 ELSE 1 END, CASE WHEN a <= 32 AND 32 < b THEN 0 ELSE abs((a + b) / 2 - 32) END, a) AS k FROM runs),
band AS (SELECT frame, a, b FROM pick WHERE k = 1 AND b - a >= 3 AND b - a <= 0.35 * 64 AND abs((a + b) / 2 - 32) <= 16)"""


_GLOBAL = "globals AS (SELECT frame, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS dr, count(DISTINCT floor(v * 255)) AS levels, avg(CASE WHEN v <= 1e-6 OR v >= 1 - 1e-6 THEN 1.0 ELSE 0.0 END) AS sat FROM pings GROUP BY frame)"
_DEAD = _dead_sql("pings")
_SPECKLE = """blocks AS (SELECT frame, avg(v) AS mu, stddev_pop(v) AS sd FROM (SELECT *, max(ping) OVER (PARTITION BY frame) + 1 AS high FROM pings) WHERE high >= 4 AND ping < high // least(16, high) * least(16, high) AND bin < 64 GROUP BY frame, ping // least(16, high), bin // 16), cvs AS (SELECT frame, sd / mu AS cv FROM blocks WHERE mu > 1e-3),
cut AS (SELECT frame, quantile_cont(cv, 0.25) AS q FROM cvs GROUP BY frame), speckle AS (SELECT frame, median(cv) AS speckle FROM cvs JOIN cut USING (frame) WHERE cv <= q GROUP BY frame)"""
_BLUR = """lap AS (SELECT frame, -4 * v + lag(v) OVER al + lead(v) OVER al + lag(v) OVER ac + lead(v) OVER ac AS lap FROM pings WINDOW al AS (PARTITION BY frame, bin ORDER BY ping), ac AS (PARTITION BY frame, ping ORDER BY bin)),
blur AS (SELECT frame, var_pop(lap) AS blur FROM lap GROUP BY frame)"""
_BAND = _band_sql("pings")
_QC = f"""{_GLOBAL}, {_DEAD}, {_SPECKLE}, {_BLUR}, {_BAND}, dropped AS (SELECT frame, avg(CASE WHEN dead THEN 1.0 ELSE 0.0 END) AS dropped FROM dead GROUP BY frame),
qc AS (SELECT *, greatest(0, 1 - (coalesce((b - a) / 64, 0) + dropped)) AS usable FROM globals JOIN dropped USING (frame) LEFT JOIN speckle USING (frame) JOIN blur USING (frame) LEFT JOIN band USING (frame)),
scored AS (SELECT *, least(1, greatest(0, 0.25 * least(1, greatest(0, dr / 0.6)) + 0.25 * (1 - least(1, dropped / 0.2)) + 0.15 * (1 - least(1, sat / 0.3))
    + 0.2 * CASE WHEN speckle IS NULL THEN 0.5 ELSE 1 - least(1, greatest(0, (speckle - 0.15) / 0.55)) END + 0.15 * usable)) AS quality FROM qc)"""


def _repair_sql(src: str, out: str) -> str:
    return f"""{out}_f AS (SELECT * FROM {src} JOIN dead USING (frame, ping)), {out}_near AS (
        SELECT *, last_value(CASE WHEN NOT dead THEN ping END IGNORE NULLS) OVER b AS p, last_value(CASE WHEN NOT dead THEN v END IGNORE NULLS) OVER b AS pv,
               first_value(CASE WHEN NOT dead THEN ping END IGNORE NULLS) OVER a AS n, first_value(CASE WHEN NOT dead THEN v END IGNORE NULLS) OVER a AS nv
        FROM {out}_f WINDOW b AS (PARTITION BY frame, bin ORDER BY ping ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY frame, bin ORDER BY ping ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    ), {out} AS (SELECT frame, ping, bin, CASE WHEN dead THEN coalesce((1 - (ping - p) / (n - p)) * pv + (ping - p) / (n - p) * nv, pv, nv, v) ELSE v END AS v FROM {out}_near)"""


#: Mirrored at the edges without repeating them, as often as it takes; a frame of one row stands for all.
_MIRROR = "CASE WHEN {1} = 1 THEN 0 ELSE ({1}) - 1 - abs(({1}) - 1 - (({0}) + 4 * (({1}) - 1)) % (2 * greatest(({1}) - 1, 1))) END"


def _across(bin: str) -> str:
    """A bin mirrored at the sides; in a frame of one ping, which can't be mirrored, the ends are repeated."""
    return f"CASE WHEN a.high = 1 THEN least(greatest({bin}, 0), 63) ELSE {_MIRROR.format(bin, '64')} END"


def _tall(src: str) -> str:
    """``src`` with each frame's own number of pings; the last frame of a table may have fewer than the others."""
    return f"(SELECT *, max(ping) OVER (PARTITION BY frame) + 1 AS high FROM {src})"


def _lee_sql(src: str, out: str) -> str:
    return f"""{out}_d(d) AS (VALUES (-2), (-1), (0), (1), (2)),
    {out}_h AS (SELECT a.frame, a.ping, a.bin, a.high, sum(b.v) / 5 AS m, sum(b.v * b.v) / 5 AS q FROM {_tall(src)} a CROSS JOIN {out}_d JOIN {src} b ON b.frame = a.frame AND b.ping = a.ping AND b.bin = {_across("a.bin + d")} GROUP BY ALL),
    {out}_l AS (SELECT a.frame, a.ping, a.bin, sum(b.m) / 5 AS m, sum(b.q) / 5 AS q FROM {out}_h a CROSS JOIN {out}_d JOIN {out}_h b ON b.frame = a.frame AND b.bin = a.bin AND b.ping = {_MIRROR.format("a.ping + d", "a.high")} GROUP BY ALL),
    {out}_g AS (SELECT frame, var_pop(v) / power(avg(v) + 1e-6, 2) AS cu2 FROM {src} GROUP BY frame), {out}_s AS (SELECT *, greatest(q - m * m, 0) AS var FROM {src} JOIN {out}_l USING (frame, ping, bin) JOIN {out}_g USING (frame)),
    {out} AS (SELECT frame, ping, bin, least(1, greatest(0, m + var / (var + cu2 * m * m + 1e-8) * (v - m))) AS v FROM {out}_s)"""


def _gain_sql(src: str, out: str) -> str:
    return f"""{out}_c AS (SELECT frame, bin, avg(v) AS m FROM {src} GROUP BY ALL), {out}_p AS (SELECT a.frame, a.bin, greatest(0.25 * l.m + 0.5 * a.m + 0.25 * r.m, 1e-3) AS p
    FROM {out}_c a JOIN {out}_c l ON l.frame = a.frame AND l.bin = abs(a.bin - 1) JOIN {out}_c r ON r.frame = a.frame AND r.bin = CASE WHEN a.bin = 63 THEN 62 ELSE a.bin + 1 END),
    {out}_t AS (SELECT frame, avg(v) AS t FROM {src} GROUP BY frame), {out} AS (SELECT frame, ping, bin, least(1, greatest(0, v * (t / p))) AS v FROM {src} JOIN {out}_p USING (frame, bin) JOIN {out}_t USING (frame))"""


def _stretch_sql(src: str, out: str) -> str:
    return f"""{out}_c AS (SELECT frame, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {src} GROUP BY frame),
    {out} AS (SELECT frame, ping, bin, CASE WHEN hi - lo < 1e-6 THEN v ELSE least(1, greatest(0, (v - lo) / (hi - lo))) END AS v FROM {src} JOIN {out}_c USING (frame))"""


def _equalise_sql(src: str, out: str) -> str:
    return f"""{out}_l AS (SELECT *, floor(v * 255) AS level FROM {src}), {out}_n AS (SELECT frame, level, count(*) AS n FROM {out}_l GROUP BY ALL),
    {out}_p AS (SELECT frame, level, sum(n) OVER up AS upto, sum(n) OVER (PARTITION BY frame) AS total, first_value(n) OVER up AS first FROM {out}_n WINDOW up AS (PARTITION BY frame ORDER BY level)),
    {out} AS (SELECT frame, ping, bin, CASE WHEN total = first THEN level ELSE round_even((upto - first) * (255.0::DOUBLE / (total - first)), 0) END / 255 AS v FROM {out}_l JOIN {out}_p USING (frame, level))"""


def _clahe_sql(src: str, out: str) -> str:
    """A grid of eight on frames of 64 columns: mirrored by what the grid lacks (a whole grid where one side fits already), cells of their own area."""
    return f"""{out}_g AS (SELECT frame, ping, bin, high, floor(v * 255)::INTEGER AS g FROM {_tall(src)}),
    {out}_a AS (SELECT *, (high + 8 - high % 8) // 8 AS ch, 9 AS cw FROM (SELECT frame, any_value(high) AS high FROM {out}_g GROUP BY frame) WHERE high % 8 > 0 UNION ALL
        SELECT *, high // 8, 8 FROM (SELECT frame, any_value(high) AS high FROM {out}_g GROUP BY frame) WHERE high % 8 = 0),
    {out}_b AS (SELECT *, ch * cw AS area, greatest(2 * ch * cw // 256, 1) AS clip FROM {out}_a),
    {out}_p AS (SELECT frame, y // ch AS ty, x // cw AS tx, {_MIRROR.format("y", "high")} AS ping, {_across("x")} AS bin FROM {out}_b a JOIN range(64) p(y) ON y < 8 * ch JOIN range(72) q(x) ON x < 8 * cw),
    {out}_w AS (SELECT frame, ty, tx, g, count(*) AS n FROM {out}_p JOIN {out}_g USING (frame, ping, bin) GROUP BY ALL),
    {out}_c AS (SELECT frame, ty, tx, any_value(area) AS area, any_value(clip) AS clip, sum(greatest(n - clip, 0))::INTEGER AS c FROM {out}_w JOIN {out}_b USING (frame) GROUP BY ALL),
    {out}_m AS (SELECT c.frame, c.ty, c.tx, c.area, r.k, least(coalesce(w.n, 0), clip) + c // 256 + CASE WHEN c % 256 > 0 AND k % greatest(256 // nullif(c % 256, 0), 1) = 0 AND k // greatest(256 // nullif(c % 256, 0), 1) < c % 256 THEN 1 ELSE 0 END AS n
        FROM {out}_c c CROSS JOIN range(256) r(k) LEFT JOIN {out}_w w ON w.frame = c.frame AND w.ty = c.ty AND w.tx = c.tx AND w.g = r.k),
    {out}_t AS (SELECT frame, ty, tx, k, least(255, round_even(sum(n) OVER (PARTITION BY frame, ty, tx ORDER BY k) * (255.0::DOUBLE / area), 0)) AS t FROM {out}_m),
    {out}_x AS (SELECT frame, ping, bin, g, floor(ping / ch - 0.5)::INTEGER AS fy, ping / ch - 0.5 - floor(ping / ch - 0.5) AS dy, floor(bin / cw - 0.5)::INTEGER AS fx, bin / cw - 0.5 - floor(bin / cw - 0.5) AS dx FROM {out}_g JOIN {out}_b USING (frame)),
    {out} AS (SELECT x.frame, ping, bin, round_even((a.t * (1 - dx) + b.t * dx) * (1 - dy) + (c.t * (1 - dx) + d.t * dx) * dy, 0) / 255 AS v FROM {out}_x x
        JOIN {out}_t a ON a.frame = x.frame AND a.k = g AND a.ty = greatest(fy, 0) AND a.tx = greatest(fx, 0) JOIN {out}_t b ON b.frame = x.frame AND b.k = g AND b.ty = a.ty AND b.tx = least(fx + 1, 7)
        JOIN {out}_t c ON c.frame = x.frame AND c.k = g AND c.ty = least(fy + 1, 7) AND c.tx = a.tx JOIN {out}_t d ON d.frame = x.frame AND d.k = g AND d.ty = c.ty AND d.tx = b.tx)"""


def _median_sql(src: str, out: str) -> str:
    return f"""{out}_d(dx) AS (VALUES (-1), (0), (1)), {out}_e(dy) AS (VALUES (-1), (0), (1)), {out} AS (SELECT a.frame, a.ping, a.bin, median(b.v) AS v FROM {_tall(src)} a CROSS JOIN {out}_d CROSS JOIN {out}_e
    JOIN {src} b ON b.frame = a.frame AND b.ping = least(greatest(a.ping + dy, 0), a.high - 1) AND b.bin = least(greatest(a.bin + dx, 0), 63) GROUP BY ALL)"""


def _levels_sql(src: str, out: str) -> str:
    return f"{out} AS (SELECT frame, ping, bin, floor(v * 255) / 255 AS v FROM {src})"


def _rank_sql(src: str, out: str, size: int, pick: str) -> str:
    """Least or greatest over an ellipse, whose chords come from its equation."""
    r = size // 2
    return f"""{out}_o AS (SELECT dy, dx FROM range(-{r}, {r + 1}) a(dy) CROSS JOIN range(-{r}, {r + 1}) b(dx) WHERE abs(dx) <= round_even({r} * sqrt(({r * r} - dy * dy) / {r * r}), 0)),
    {out} AS (SELECT a.frame, a.ping, a.bin, {pick}(b.v) AS v FROM {src} a CROSS JOIN {out}_o JOIN {src} b ON b.frame = a.frame AND b.ping = a.ping + dy AND b.bin = a.bin + dx GROUP BY ALL)"""


@query(f"WITH {PINGS}, {_GLOBAL} SELECT frame, {micro_sql('dr')} AS dynamic_range, levels AS unique_levels, {micro_sql('sat')} AS saturated_ratio FROM globals")
def qc_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG7, AG19, AR1: range, levels and clipping of each frame."""
    return I.assess(frame_arrays(spark, sf_dir)).select("frame", "unique_levels", *[micro(F.col(c)).alias(c) for c in ("dynamic_range", "saturated_ratio")])


@query(f"WITH {PINGS}, {_DEAD} SELECT frame, ping FROM dead WHERE dead")
def qc_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG3: dead rows."""
    return I.each(frame_arrays(spark, sf_dir), lambda image, _: [{"ping": int(k)} for k in R.dead_rows(image).nonzero()[0]], "ping long")


@query(f"WITH {PINGS}, {_SPECKLE} SELECT frame, {micro_sql('speckle')} AS speckle_index FROM speckle")
def qc_speckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG4: noise of the flattest patches."""
    return I.assess(frame_arrays(spark, sf_dir)).filter("speckle_index is not null").select("frame", micro(F.col("speckle_index")).alias("speckle_index"))


@query(f"WITH {PINGS}, {_BLUR} SELECT frame, {micro_sql('blur')} AS blur_score FROM blur")
def qc_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG5: sharpness."""
    return I.assess(frame_arrays(spark, sf_dir)).select("frame", micro(F.col("blur_score")).alias("blur_score"))


@query(f'WITH {PINGS}, {_BAND} SELECT frame, a AS start, b AS "end" FROM band')
def qc_water_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG2, WN4, WN6, WN7: the dark band under the sonar."""
    return I.assess(frame_arrays(spark, sf_dir)).filter("band_start is not null").select("frame", F.col("band_start").alias("start"), F.col("band_end").alias("end"))


@query(f"WITH {PINGS}, {_QC} SELECT frame, {micro_sql('quality')} AS quality_score, {micro_sql('usable')} AS usable_region_ratio FROM scored")
def qc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG6, IMG7: the composite score."""
    return I.assess(frame_arrays(spark, sf_dir)).select("frame", micro(F.col("quality_score")).alias("quality_score"), micro(F.col("usable_region_ratio")).alias("usable_region_ratio"))


@query(
    f"""WITH {PINGS}, {_QC} SELECT frame, concat_ws(' | ', CASE WHEN dr < 0.15 THEN 'Very low dynamic range - contrast normalisation strongly recommended.' END, CASE WHEN dropped > 0.05 THEN printf('%.1f%%', 100 * dropped) || ' of ping rows are dead (probable data dropout).' END,
    CASE WHEN sat > 0.25 THEN printf('%.1f%%', 100 * sat) || ' of pixels are clipped at black/white.' END, CASE WHEN speckle > 0.5 THEN 'High speckle index - denoising recommended before detection.' END,
    CASE WHEN a IS NULL THEN 'No water-column band detected (image may already be nadir-removed or georectified).' ELSE printf('Water column detected at columns %d-%d (%.1f%% of swath width).', a, b, 100 * (b - a) / 64) END,
    CASE WHEN levels < 32 THEN printf('Only %d distinct intensity levels - possible over-quantisation.', levels) END) AS notes FROM scored"""
)
def qc_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG7, PRJ6: what an operator should know of a frame."""
    return I.assess(frame_arrays(spark, sf_dir)).select("frame", F.array_join("notes", " | ").alias("notes"))


def _five(x: str) -> str:
    return f"floor({x} * 1e5 + 0.5) / 1e5"


_OUT = "SELECT frame, ping, bin::INTEGER AS bin, {} AS v FROM {}"


def _shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("frame", "ping", F.col("bin").cast("int").alias("bin"), (F.floor(F.col("v") * 10**digits + 0.5) / 10**digits).alias("v"))


def _through(spark: SparkSession, sf_dir: str, kernel: Callable, digits: int = 6) -> DataFrame:
    """The test frames through a kernel, pixel by pixel."""
    return _shown(I.to_pixels(I.mapped(frame_arrays(spark, sf_dir), kernel)), digits)


@query(f"WITH {PINGS}, {_gain_sql('pings', 'done')} {_OUT.format(micro_sql('v'), 'done')}")
def gain_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG10, WN5: brightness evened out across the track."""
    return _through(spark, sf_dir, R.even_gain)


@query(f"WITH {PINGS}, {_stretch_sql('pings', 'done')} {_OUT.format(micro_sql('v'), 'done')}")
def dr_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG11: percentile stretch."""
    return _through(spark, sf_dir, R.stretch)


@query(f"WITH {PINGS}, {_equalise_sql('pings', 'done')} {_OUT.format(micro_sql('v'), 'done')}")
def hist_equalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG12, SC25: histogram equalisation."""
    return _through(spark, sf_dir, R.equalize)


@query(f"WITH {PINGS}, {_DEAD}, {_repair_sql('pings', 'done')} {_OUT.format(micro_sql('v'), 'done')}")
def dropout_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG15, WN3: dead rows interpolated."""
    return _through(spark, sf_dir, lambda image: R.repair_rows(image, R.dead_rows(image)))



@query(f"WITH {PINGS}, {_lee_sql('pings', 'done')} {_OUT.format(_five('v'), 'done')}")
def lee_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG8: speckle filter; shown to five decimals."""
    return _through(spark, sf_dir, R.lee, 5)


@query(f"WITH {PINGS}, {_BAND}, m AS (SELECT frame, median(v) AS med FROM pings GROUP BY frame), done AS (SELECT frame, ping, bin, CASE WHEN bin >= a AND bin < b THEN med ELSE v END AS v FROM pings LEFT JOIN band USING (frame) JOIN m USING (frame)) {_OUT.format(micro_sql('v'), 'done')}")
def wc_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG9: the band masked by the median."""
    return _through(spark, sf_dir, lambda image: I.without_band(image, "mask", R.water_column(image)))


@query(f"WITH {PINGS}, {_BAND}, done AS (SELECT frame, ping, CASE WHEN bin >= b THEN bin - (b - a) ELSE bin END AS bin, v FROM pings LEFT JOIN band USING (frame) WHERE a IS NULL OR bin < a OR bin >= b) {_OUT.format(micro_sql('v'), 'done')}")
def wc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG9: the band cut out."""
    return _through(spark, sf_dir, lambda image: I.without_band(image, "split", R.water_column(image)))


@query(
    f"""WITH {PINGS}, k AS (SELECT unnest(range(32)) AS k), src AS (SELECT k, least(sqrt(power(k * (sqrt(32.0::DOUBLE * 32 - 36) + 1e-6) / 31, 2) + 36), 31) AS s FROM k),
    places AS (SELECT 31 - k AS bin, greatest(31 - s, 0) AS x FROM src UNION ALL SELECT 32 + k, least(32 + s, 63) FROM src),
    done AS (SELECT a.frame, a.ping, t.bin, a.v * (1 - (x - floor(x))) + b.v * (x - floor(x)) AS v FROM places t JOIN pings a ON a.bin = floor(x) JOIN pings b ON b.frame = a.frame AND b.ping = a.ping AND b.bin = least(floor(x) + 1, 63)) {_OUT.format(micro_sql("v"), "done")}"""
)
def slant_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG16: slant range to ground range at an altitude of six bins."""
    return _through(spark, sf_dir, lambda image: R.slant_to_ground(image, 6.0))


@query(f"WITH {PINGS}, done AS (SELECT frame, ping, bin, least(1, greatest(0, least(1, greatest(0, m + (v - m) * 0.5)) * 1.5)) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY frame) AS m FROM pings)) {_OUT.format(micro_sql('v'), 'done')}")
def contrast_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG24: lower contrast, then a gain."""
    return _through(spark, sf_dir, lambda image: R.amplified(R.contrast(image, 0.5), 1.5))


@query(f"WITH {PINGS}, {_median_sql('pings', 'done')} {_OUT.format(micro_sql('v'), 'done')}")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG17: three by three median."""
    return _through(spark, sf_dir, R.median)


@query(
    f"""WITH {PINGS}, y AS (SELECT unnest(range(0, 35, 8)) AS py), x AS (SELECT unnest(range(0, 49, 8)) AS px) SELECT frame, py::INTEGER AS py, px::INTEGER AS px, count(*) AS pixels, {micro_sql("avg(v)")} AS mean
    FROM {_tall("pings")} JOIN y ON ping >= py AND ping < py + 16 AND py + 16 <= high JOIN x ON bin >= px AND bin < px + 16 GROUP BY ALL"""
)
def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG25, IMG23: overlapping square patches."""
    cut = K.patches(pings(spark, sf_dir), 16, 8)
    return cut.groupBy("frame", "py", "px").agg(F.count(F.lit(1)).alias("pixels"), micro(F.avg("v")).alias("mean"))


@query(f"WITH {PINGS}, e AS (SELECT frame, abs(v - avg(v) OVER (PARTITION BY frame)) AS e FROM pings) SELECT frame, {micro_sql('quantile_cont(e, 0.99)')} AS p99, {micro_sql('max(e)')} AS top, {micro_sql('avg(e)')} AS mean, {micro_sql('(avg(e) - 0.05) / 0.02')} AS z FROM e GROUP BY frame")
def anomaly_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, SC23: reductions of a frame's error field and its z-score."""
    from pyspark.sql import Window

    e = pings(spark, sf_dir).select("frame", F.abs(F.col("v") - F.avg("v").over(Window.partitionBy("frame"))).alias("e"))
    mean = F.avg("e")
    return e.groupBy("frame").agg(micro(F.percentile("e", F.lit(0.99))).alias("p99"), micro(F.max("e")).alias("top"), micro(mean).alias("mean"), micro((mean - 0.05) / 0.02).alias("z"))


_PLACES = """b AS (SELECT frame, idx, x0, y0, x0 + bw AS x1, y0 + bh AS y1, bw, bh, CAST(floor(greatest(bw, bh) * 1.5) AS INTEGER) + 4 AS pad, greatest(4, CAST(floor(bw * 1.2) AS INTEGER)) AS strip
    FROM (SELECT DISTINCT frame FROM pings) CROSS JOIN (VALUES (0, 10, 8, 9, 7), (1, 28, 20, 9, 7), (2, 50, 38, 9, 7), (3, 0, 0, 9, 7), (4, 40, 30, 1, 3)) t(idx, x0, y0, bw, bh))"""
#: The eight features that SQL can say, from a table of pixels; those of a box of fewer than four pixels are all 0.
_FEATURES = f"""near AS (SELECT b.*, v, ping, bin, ping >= y0 AND ping < y1 AS rws, ping >= y0 AND ping < y1 AND bin >= x0 AND bin < x1 AS ins FROM seen JOIN b USING (frame) WHERE bin >= x0 - pad AND bin < x1 + pad AND ping >= y0 - pad AND ping < y1 + pad),
    base AS (SELECT frame, idx, x0, x1, bw, bh, count(*) FILTER (WHERE ins) AS n, avg(v) FILTER (WHERE ins) AS tm, max(v) FILTER (WHERE ins) AS tx, avg(v) FILTER (WHERE NOT ins) AS bm, stddev_pop(v) FILTER (WHERE NOT ins) AS bs,
        avg(v) FILTER (WHERE rws AND bin >= x0 - strip AND bin < x0) AS lm, avg(v) FILTER (WHERE rws AND bin >= x1 AND bin < x1 + strip) AS rm FROM near GROUP BY ALL),
    crops AS (SELECT frame, idx, 't' AS kind, y0 AS ya, y1 AS yb, x0 AS xa, x1 AS xb FROM b UNION ALL SELECT frame, idx, 'r', greatest(0, y0 - pad), least(50, y1 + pad), greatest(0, x0 - pad), least(64, x1 + pad) FROM b),
    taps AS (SELECT dy, dx, dx * (2 - abs(dy)) AS gx, dy * (2 - abs(dx)) AS gy FROM range(-1, 2) p(dy) CROSS JOIN range(-1, 2) q(dx)),
    sobel AS (SELECT c.frame, c.idx, kind, a.ping, a.bin, sqrt(power(sum(gx * o.v), 2) + power(sum(gy * o.v), 2)) AS g FROM crops c JOIN seen a ON a.frame = c.frame AND a.ping >= ya AND a.ping < yb AND a.bin >= xa AND a.bin < xb CROSS JOIN taps
        JOIN seen o ON o.frame = c.frame AND o.ping = CASE WHEN a.ping + dy < ya THEN 2 * ya - a.ping - dy WHEN a.ping + dy >= yb THEN 2 * yb - 2 - a.ping - dy ELSE a.ping + dy END
        AND o.bin = CASE WHEN a.bin + dx < xa THEN 2 * xa - a.bin - dx WHEN a.bin + dx >= xb THEN 2 * xb - 2 - a.bin - dx ELSE a.bin + dx END WHERE c.idx <> 4 GROUP BY ALL),
    energy AS (SELECT frame, idx, avg(g) FILTER (WHERE kind = 't') AS gt, avg(g) FILTER (WHERE kind = 'r') AS gr FROM sobel GROUP BY ALL),
    shade AS (SELECT *, (bm - coalesce(lm, bm)) / (bm + 1e-6) AS dl, (bm - coalesce(rm, bm)) / (bm + 1e-6) AS dr FROM base LEFT JOIN energy USING (frame, idx) LEFT JOIN (SELECT frame, (a + b) / 2 AS nadir FROM band) USING (frame)),
    feats AS (SELECT frame, idx, n >= 4 AS big, least(10, greatest(-10, (tm - bm) / (bs + 1e-6))) AS target_contrast, least(1, greatest(0, greatest(dl, dr))) AS shadow_ratio,
        CASE WHEN nadir IS NULL THEN 0.5 WHEN ((x0 + x1) / 2 < nadir) = (dl >= dr) THEN 1.0 ELSE 0.0 END AS shadow_side_consistent, greatest(bw, bh) / least(bw, bh) AS aspect_ratio, gr / (gt + gr) AS texture_homogeneity,
        least(1, bs) AS background_roughness, least(20, greatest(-10, (tx - bm) / (bs + 1e-6))) AS local_snr, (log10(greatest(bw * bh / 3200, 1e-6)) + 6) / 6 AS size_rank FROM shade)"""
_SHOWN = ("target_contrast", "shadow_ratio", "shadow_side_consistent", "aspect_ratio", "texture_homogeneity", "background_roughness", "local_snr", "size_rank")


@query(f"WITH {PINGS}, {_BAND}, {_PLACES}, seen AS (SELECT * FROM pings), {_FEATURES} SELECT frame, idx, {', '.join(f'CASE WHEN big THEN {micro_sql(c)} ELSE 0.0 END AS {c}' for c in _SHOWN)} FROM feats")
def region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG22: features of boxes in their frames, here five boxes in each, one of them too small to have any."""
    frames = frame_arrays(spark, sf_dir)
    return I.region_features(frames, _five_boxes(frames)).select("frame", "idx", *[micro(F.col(c)).alias(c) for c in _SHOWN])


@query()
def highlight_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG22: compactness and straightness of each box's highlight, from its border; held against worked shapes in the tests."""
    frames = frame_arrays(spark, sf_dir)
    return I.region_features(frames, _five_boxes(frames)).select("frame", "idx", micro(F.col("highlight_compactness")).alias("highlight_compactness"), micro(F.col("edge_straightness")).alias("edge_straightness"))


@query(f"WITH {PINGS}, {_levels_sql('pings', 'levels')}, {_rank_sql('levels', 'eroded', 3, 'min')}, {_rank_sql('eroded', 'done', 3, 'max')} {_OUT.format(micro_sql('v'), 'done')}")
def morphology_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG14: opening by a cross."""
    return _through(spark, sf_dir, R.morphology)


@query(f"WITH {PINGS}, top AS (SELECT *, max(v * 200) OVER (PARTITION BY frame) AS m FROM pings), done AS (SELECT frame, ping, bin, least(1, greatest(0, CASE WHEN m > 1.5 THEN v * 200 / 255 ELSE v * 200 END)) AS v FROM top) {_OUT.format(micro_sql('v'), 'done')}")
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG1: 8-bit frames scaled to 0 to 1."""
    return _shown(K.to_unit(pings(spark, sf_dir).withColumn("v", F.col("v") * 200)))


@query(f"WITH {PINGS}, {_DEAD}, {_repair_sql('pings', 'whole')}, {_lee_sql('whole', 'calm')}, {_gain_sql('calm', 'even')}, {_stretch_sql('even', 'done')} {_OUT.format(_five('v'), 'done')}")
def condition_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG18: the standard profile, dead rows to stretch."""
    return _shown(I.to_pixels(I.condition(frame_arrays(spark, sf_dir), "standard")), 5)


@query(
    f"""WITH {PINGS}, {_levels_sql('pings', 'levels')}, {_median_sql('levels', 'calm')}, {_equalise_sql('calm', 'flat')}, {_clahe_sql('flat', 'local')},
    {_rank_sql('local', 'eroded', 3, 'min')}, {_rank_sql('eroded', 'done', 3, 'max')} {_OUT.format(micro_sql('v'), 'done')}"""
)
def condition_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG18, IMG13: a profile of one's own, all on 8-bit levels: median, equalisation, CLAHE, opening."""
    chain = I.Conditioning(dropouts=False, denoise="median", window=3, gain=None, cut=None, equalize=True, clahe=(2.0, 8), morphology=("open", 3))
    return _shown(I.to_pixels(I.condition(frame_arrays(spark, sf_dir), chain)))


@query()
def condition_thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG18: the five-step profile. No twin: between gain and equalisation values are cut to levels, where the last digit of a mean decides."""
    return _shown(I.to_pixels(I.condition(frame_arrays(spark, sf_dir), "thesis5step")), 5)


@query()
def condition_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG18, IMG9: the profile that also fills the water column and equalises locally."""
    return _shown(I.to_pixels(I.condition(frame_arrays(spark, sf_dir), "aggressive")), 5)


@query(
    f"""WITH {PINGS}, {_DEAD}, {_repair_sql('pings', 'whole')}, {_band_sql('whole')}, n AS (SELECT frame, count_if(dead) AS k, count(*) AS rows FROM dead GROUP BY frame)
    SELECT frame, concat_ws(' | ', CASE WHEN k > 0 AND k < rows THEN 'dropout_interpolation(' || k || ' rows)' END, 'water_column_removal(' || CASE WHEN a IS NULL THEN 'no band found' ELSE 'mask' END || ')',
    'slant_range_correction(SKIPPED: no altitude)', 'denoise(bilateral)', 'dynamic_range_normalization((1.0, 99.0))') AS steps, k::VARCHAR AS dead_rows, coalesce(a || '-' || b, 'none') AS water_column
    FROM n LEFT JOIN band USING (frame)"""
)
def condition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG18: what a profile did to each frame, and what it found."""
    chain = I.Conditioning(band="mask", slant=True, denoise="bilateral", gain=None)
    done = I.condition(frame_arrays(spark, sf_dir), chain)
    return done.select("frame", F.array_join("steps", " | ").alias("steps"), F.element_at("diagnostics", F.lit("dead_rows")).alias("dead_rows"), F.element_at("diagnostics", F.lit("water_column")).alias("water_column"))


@query(f"WITH {PINGS}, {_clahe_sql('pings', 'done')} {_OUT.format(micro_sql('v'), 'done')}")
def clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG13: equalisation of cells with clipped histograms."""
    return _through(spark, sf_dir, R.clahe)


@query(
    f"""WITH {PINGS}, o AS (SELECT dy, dx FROM range(-2, 3) a(dy) CROSS JOIN range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4),
    w AS (SELECT a.frame, a.ping, a.bin, b.v, exp(-(dy * dy + dx * dx) / 50.0 - power(b.v - a.v, 2) / 0.02) AS w FROM {_tall("pings")} a CROSS JOIN o
        JOIN pings b ON b.frame = a.frame AND b.ping = {_MIRROR.format("a.ping + dy", "a.high")} AND b.bin = {_across("a.bin + dx")}),
    done AS (SELECT frame, ping, bin, sum(w * v) / sum(w) AS v FROM w GROUP BY ALL) {_OUT.format(_five('v'), 'done')}"""
)
def bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG17: smoothing that stops at edges."""
    return _through(spark, sf_dir, R.bilateral, 5)


@query()
def nlm_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG17: non-local means, held against a plain version in the tests."""
    return _through(spark, sf_dir, R.non_local_means)


@query(f"WITH {PINGS}, {_levels_sql('pings', 'levels')}, {_rank_sql('levels', 'grown', 5, 'max')}, {_rank_sql('grown', 'done', 5, 'min')} {_OUT.format(micro_sql('v'), 'done')}")
def morphology_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG14: closing by an ellipse of five."""
    return _through(spark, sf_dir, lambda image: R.morphology(image, "close", 5))


@query(
    f"""WITH {PINGS}, {_levels_sql('pings', 'levels')}, {_rank_sql('levels', 'eroded', 7, 'min')}, {_rank_sql('eroded', 'opened', 7, 'max')},
    done AS (SELECT frame, ping, bin, l.v - o.v AS v FROM levels l JOIN opened o USING (frame, ping, bin)) {_OUT.format(micro_sql('v'), 'done')}"""
)
def morphology_tophat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG14: top hat by an ellipse of seven."""
    return _through(spark, sf_dir, lambda image: R.morphology(image, "tophat", 7))


@query()
def wc_inpaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG9: the band filled from its sides by fast marching, held against a plain version in the tests."""
    return _through(spark, sf_dir, lambda image: I.without_band(image, "inpaint", R.water_column(image)))


def _five_boxes(frames: DataFrame) -> DataFrame:
    """The boxes of _PLACES in every frame, with raw scores."""
    places = ((10, 8, 9, 7), (28, 20, 9, 7), (50, 38, 9, 7), (0, 0, 9, 7), (40, 30, 1, 3))
    structs = [F.struct(F.lit(i).alias("idx"), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (x, y, x + w, y + h), strict=True)], F.lit(0.1 + 0.2 * i).alias("raw")) for i, (x, y, w, h) in enumerate(places)]
    return frames.select("frame", F.inline(F.array(*structs)))


@query(
    f"""WITH {PINGS}, {_PLACES}, h AS (SELECT frame, max(ping) + 1 AS high FROM pings GROUP BY frame),
    cut AS (SELECT frame, idx, high, x0, y0, least(x1, 64) AS x1, least(y1, high) AS y1 FROM b JOIN h USING (frame) WHERE idx < 4), n AS (SELECT frame, count(*) AS n FROM cut GROUP BY frame),
    e AS (SELECT frame, idx, (x1 - x0) * (y1 - y0) / (high * 64) AS area, max(v) FILTER (WHERE ping >= y0 AND ping < y1 AND bin >= x0 AND bin < x1) - avg(v) AS c FROM pings JOIN cut USING (frame)
    WHERE x1 > x0 AND y1 > y0 AND bin >= x0 - 20 AND bin < x1 + 20 AND ping >= y0 - 20 AND ping < y1 + 20 GROUP BY frame, idx, x0, y0, x1, y1, high)
    SELECT frame, any_value(n) AS n, coalesce({micro_sql("avg(area)")}, 0) AS area, coalesce({micro_sql("avg(c)")}, 0) AS contrast FROM n LEFT JOIN e USING (frame) GROUP BY frame"""
)
def frame_target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: number, size and contrast of each frame's targets."""
    boxes = _five_boxes(frame_arrays(spark, sf_dir)).filter("idx < 4")
    return K.target_stats(pings(spark, sf_dir), boxes).withColumns({c: micro(F.col(c)) for c in ("area", "contrast")})


@query(f"WITH {PINGS} SELECT frame, c::INTEGER AS channel, count(*) AS pixels, {micro_sql('avg(v)')} AS mean FROM pings CROSS JOIN range(3) t(c) GROUP BY ALL")
def grey_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG28: grey frames as three equal channels."""
    each = K.replicate(pings(spark, sf_dir)).select("frame", F.posexplode("v").alias("channel", "v"))
    return each.groupBy("frame", "channel").agg(F.count(F.lit(1)).alias("pixels"), micro(F.avg("v")).alias("mean"))


_VERDICT = "raw < 0.15 OR snr < 1.5 OR shadow < 0.03 OR aspect > 12"
_EVIDENCE = f"""seen AS (SELECT frame, ping, bin, floor(v * 255) / 255 AS v FROM pings), {_FEATURES},
    f AS (SELECT frame, idx, 0.1::DOUBLE + 0.2::DOUBLE * idx AS raw, CASE WHEN big THEN local_snr ELSE 0 END AS snr, CASE WHEN big THEN aspect_ratio ELSE 0 END AS aspect, CASE WHEN big THEN shadow_ratio ELSE 0 END AS shadow,
        CASE WHEN big THEN target_contrast ELSE 0 END AS contrast FROM feats)"""
_LEVEL = "CASE WHEN 100 * confidence >= 85 THEN 'CRITICAL' WHEN 100 * confidence >= 65 THEN 'HIGH' WHEN 100 * confidence >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    f"""WITH {PINGS}, {_QC}, {_PLACES}, {_EVIDENCE},
    g AS (SELECT *, NOT ({_VERDICT}) AS accepted, CASE WHEN {_VERDICT} THEN raw * 0.5 ELSE raw END AS confidence FROM f)
    SELECT frame, idx, {micro_sql("quality")} AS quality_score, accepted, CASE WHEN accepted THEN 'passed heuristic checks' ELSE 'no' END AS passed, {micro_sql("confidence")} AS confidence, {_LEVEL} AS band FROM g JOIN scored USING (frame)"""
)
def process_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL1, SC20: frames from quality control over features to verdicts of the rules, which hold the raw score or halve it, whatever the calibration."""
    frames = frame_arrays(spark, sf_dir)
    done = I.process(frames, _five_boxes(frames), platt=Platt(0.85, -0.4, True))
    passed = F.when(F.col("accepted"), F.col("reason")).otherwise("no")
    return done.select("frame", "idx", micro(F.col("quality_score")).alias("quality_score"), "accepted", passed.alias("passed"), micro(F.col("confidence")).alias("confidence"), "band")


FILTER = LinearFilter({"target_contrast": 0.9, "shadow_ratio": 1.4, "raw": 2.0}, {"target_contrast": 0.2, "shadow_ratio": 0.1, "raw": 0.4}, {"target_contrast": 0.6, "shadow_ratio": 0.2, "raw": 0.25}, bias=-0.3)


@query(
    f"""WITH {PINGS}, {_QC}, {_PLACES}, {_EVIDENCE},
    p AS (SELECT *, 1 / (1 + exp(-(-0.3 + 0.9 * (contrast - 0.2) / 0.6 + 1.4 * (shadow - 0.1) / 0.2 + 2.0 * (raw - 0.4) / 0.25))) AS p, 1 / (1 + exp(-(0.85 * ln(raw / (1 - raw)) + -0.4))) AS c FROM f),
    g AS (SELECT *, p >= 0.5 AS accepted, sqrt(p * c) AS confidence FROM p)
    SELECT frame, idx, accepted, {micro_sql("confidence")} AS confidence, {_LEVEL} AS band FROM g"""
)
def process_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL1, SC20: the same with a fitted filter, whose probability moves the calibrated score."""
    frames = frame_arrays(spark, sf_dir)
    done = I.process(frames, _five_boxes(frames), rules=FILTER, platt=Platt(0.85, -0.4, True))
    return done.select("frame", "idx", "accepted", micro(F.col("confidence")).alias("confidence"), "band")


@query()
def robustness_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG24, PL5: eighteen conditions through process and matching, with the recall that each keeps of the baseline's; the noise can be made again, but not in SQL."""
    frames = frame_arrays(spark, sf_dir)
    boxes = _five_boxes(frames)
    truths = boxes.filter("idx in (0, 1, 3) and frame % 3 <> 0").withColumn("cls", F.lit(0))
    rows = I.robustness(frames, boxes, truths, "none")
    return rows.select("condition", "level", *[F.col(c).cast("long").alias(c) for c in ("n_frames", "n_gt_objects", "n_detections", "tp", "fp", "fn", "false_alarm_frames")], *[micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "recall_retained")])


@query(
    f"""WITH {PINGS}, k(name, level, factor, gain) AS (VALUES ('baseline', NULL, 1.0, 1.0), ('low_contrast', 0.7, 0.7, 1.0), ('low_contrast', 0.5, 0.5, 1.0), ('low_contrast', 0.3, 0.3, 1.0), ('gain_shift', 0.6, 1.0, 0.6), ('gain_shift', 1.5, 1.0, 1.5)),
    m AS (SELECT *, avg(v) OVER (PARTITION BY frame) AS m FROM pings), c AS (SELECT frame, name, level, CASE WHEN name = 'baseline' THEN v ELSE floor(least(1, greatest(0, (m + (v - m) * factor) * gain)) * 255) / 255 END AS v FROM m CROSS JOIN k)
    SELECT frame, name AS condition, level::DOUBLE AS level, {micro_sql("avg(v)")} AS mean, {micro_sql("max(v)")} AS top FROM c GROUP BY ALL"""
)
def perturbed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG24: what the conditions without noise or resampling make of each frame's mean and maximum."""
    chosen = [c for c in I.CONDITIONS if c[0] in ("baseline", "low_contrast", "gain_shift")]

    def work(image, _):
        for name, level in chosen:
            changed = I.perturbed(image, name, level, [0])
            yield {"condition": name, "level": level, "mean": float(changed.mean()), "top": float(changed.max())}

    return I.each(frame_arrays(spark, sf_dir), work, "condition string, level double, mean double, top double").withColumns({c: micro(F.col(c)) for c in ("mean", "top")})


@query(
    f"""WITH {PINGS}, e AS (SELECT frame, abs(v - avg(v) OVER (PARTITION BY frame)) AS e FROM pings), a AS (SELECT frame, quantile_cont(e, 0.99) AS p99, avg(e) AS mean, frame % 3 = 0 AS odd FROM e GROUP BY frame),
    r AS (SELECT odd, rank() OVER (ORDER BY p99) AS rp, rank() OVER (ORDER BY mean) AS rm FROM a), n AS (SELECT count_if(odd) AS p, count_if(NOT odd) AS m, sum(CASE WHEN odd THEN rp END) AS sp, sum(CASE WHEN odd THEN rm END) AS sm FROM r)
    SELECT {micro_sql("(sp - p * (p + 1) / 2) / (p * m)")} AS auc_p99, {micro_sql("(sm - p * (p + 1) / 2) / (p * m)")} AS auc_mean, p AS positives, m AS negatives FROM n"""
)
def anomaly_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL6: areas under the curve of two reductions of a frame's error field; frames with a dead ping are the odd ones."""

    def work(image, _):
        error = abs(image - image.mean())
        yield {"p99": float(np.percentile(error, 99)), "mean": float(error.mean())}

    scores = I.each(frame_arrays(spark, sf_dir), work, "p99 double, mean double").withColumn("label", (F.col("frame") % 3 == 0).cast("int"))
    p99, mean = (roc_auc(scores.select("frame", F.col(c).alias("score"), "label"), "frame") for c in ("p99", "mean"))
    return p99.crossJoin(F.broadcast(mean.select(F.col("auc").alias("auc_mean")))).select(micro(F.col("auc")).alias("auc_p99"), micro(F.col("auc_mean")).alias("auc_mean"), "positives", "negatives")  # one row each


@query()
def preprocess_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL4: the metrics of every profile through process and matching, against the frames as recorded."""
    frames = frame_arrays(spark, sf_dir)
    boxes = _five_boxes(frames)
    truths = boxes.filter("idx in (0, 1, 3) and frame % 3 <> 0").withColumn("cls", F.lit(0))
    rows = I.ablation(frames, boxes, truths)
    return rows.select("profile", *[F.col(c).cast("long").alias(c) for c in ("n_frames", "n_gt_objects", "n_detections", "tp", "fp", "fn", "false_alarm_frames")], *[micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "recall_retained")])
