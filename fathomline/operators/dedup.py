"""Grouping of observations into hazards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.boxes import iou
from fathomline.functions.geo import EARTH_RADIUS_M, haversine_m
from fathomline.session import checkpoint, saved


#: Cells of the finest grid, in metres; each level is twice as coarse as the one before.
FINEST_M = 1.0
#: Less than a degree has anywhere, so that cells are never too narrow.
LEAST_METRES_PER_DEGREE = 110_000.0
COARSEST_LEVEL = 25


def _level(reach: Column) -> Column:
    """The first grid whose cells are as wide as twice a row's own reach."""
    wide = 2 * reach / FINEST_M
    return F.least(F.lit(COARSEST_LEVEL), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide, F.lit(1e-9))))).cast("int"))


def _row_of(lat: Column, level: Column) -> Column:
    return F.floor(lat * LEAST_METRES_PER_DEGREE / (FINEST_M * F.pow(F.lit(2.0), level))).cast("long")


def _column_of(lon: Column, row: Column, level: Column) -> tuple[Column, Column]:
    """(column, number of columns) of a longitude in a row of cells.

    A row has a whole number of columns around the globe, as many as leave each
    wide enough for the row itself and its neighbours, so the last is beside the first.
    """
    degrees = FINEST_M * F.pow(F.lit(2.0), level) / LEAST_METRES_PER_DEGREE
    farthest = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * degrees), F.abs((row + 2) * degrees)))
    wide = 1.01 * degrees / F.greatest(F.cos(F.radians(farthest)), F.lit(1e-12))
    n = F.when(wide > 30, F.lit(1)).otherwise(F.floor(360 / wide)).cast("long")
    return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n), n


def _pairs(located: DataFrame, radius_m: float, shown: str) -> DataFrame:
    """``x, y``: the ``shown`` columns of every pair of rows ``obs, cls, lat, lon, unc`` within reach of each other, where they differ.

    A row's own reach is half of the radius and of its uncertainty, so a pair
    is no farther apart than both reaches. Rows lie on grids of doubling cells:
    each looks around itself on the first whose cells are twice its reach, and
    is there to be found on that one and on all coarser ones in use. So one
    poor fix widens its own cells only. Rows of cells close around the globe,
    and the class is part of a cell's key. Each pair meets in one cell once.
    """
    located = located.select("obs", "cls", "lat", "lon", "unc", F.col(shown).alias("shown"), _level(0.5 * (radius_m + F.col("unc"))).alias("level"))
    used = sorted(located.agg(F.collect_set("level")).first()[0] or [])  # at most COARSEST_LEVEL + 1
    if not used:
        return located.select(F.col("shown").alias("x"), F.col("shown").alias("y")).limit(0)
    there = located.withColumn("grid", F.explode(F.filter(F.array(*map(F.lit, used)), lambda g: g >= F.col("level")))).withColumn("row", _row_of(F.col("lat"), F.col("grid")))
    there = there.withColumn("col", _column_of(F.col("lon"), F.col("row"), F.col("grid"))[0])
    there = there.select("grid", "row", "col", "cls", *[F.col(c).alias(f"o_{c}") for c in ("obs", "lat", "lon", "unc", "level", "shown")])
    # Plain columns and literal arrays compile; the same in lambdas would be interpreted row by row.
    here = located.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("row", _row_of(F.col("lat"), F.col("level")) + F.col("step"))
    column, n = _column_of(F.col("lon"), F.col("row"), F.col("level"))
    here = here.withColumn("n", n).withColumn("at", column).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("step < n")
    here = here.withColumn("col", F.pmod(F.col("at") + F.col("step") - 1, F.col("n"))).drop("at", "n", "step").withColumnRenamed("level", "grid")
    met = here.join(there, ["grid", "row", "col", "cls"]).filter((F.col("o_level") < F.col("grid")) | (F.col("obs") < F.col("o_obs"))).filter("obs <> o_obs and shown <> o_shown")
    near = haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= radius_m + 0.5 * (F.col("unc") + F.col("o_unc"))
    return met.filter(near).select(F.col("shown").alias("x"), F.col("o_shown").alias("y"))


#: What tells small cells apart.
_CELL = ("_cls", "_row", "_column")


def _in_cells(obs: DataFrame, radius_m: float, class_aware: bool) -> DataFrame:
    """Adds the small cell of each row: all rows of one class in a cell are within the radius of each other, as its diagonal is shorter."""
    # A degree of latitude has 111195 m; half the radius to a side leaves room for the curvature of the largest cells, too.
    side = F.lit(0.5 * min(radius_m, 1e6)) * F.lit(1.0) / 111_200.0
    row = F.floor(F.col("lat") / side).cast("long")
    widest = F.cos(F.radians(F.greatest(F.lit(0.0), F.least(F.abs(row * side), F.abs((row + 1) * side)))))
    widest = F.when((row * side <= 0) & ((row + 1) * side >= 0), F.lit(1.0)).otherwise(widest)
    columns = F.greatest(F.lit(1), F.ceil(360 * widest / side)).cast("long")
    column = F.floor((F.pmod(F.col("lon") + 180, F.lit(360.0))) / 360 * columns).cast("long")
    row, column = (row, column) if radius_m > 0 else (F.col("lat"), F.col("lon"))
    return obs.withColumns({"_cls": F.col("cls") if class_aware else F.lit(0), "_row": row, "_column": column})


def _known(placed: DataFrame) -> DataFrame:
    """Rows that have a class and a position, with longitudes from -180 to 180."""
    known = placed.filter("_cls is not null and lat is not null and lon is not null")
    return known.select("obs", *_CELL, "lat", (F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).alias("lon"), F.coalesce("unc", F.lit(0.0)).alias("unc"))


def _spots(placed: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(spots, cells): rows at one place as one spot with their number ``n`` and largest ``unc``, and what a cell's spots amount to.

    A spot of several uncertainties is one for each where ``by`` names ``unc``.
    Rows without a class or a position are in no pair and in neither table.
    """
    known = _known(placed)
    largest = [] if "unc" in by else [F.max("unc").alias("unc")]
    spots = saved(known.groupBy(*_CELL, "lat", "lon", *by).agg(F.count(F.lit(1)).alias("n"), F.min("obs").alias("obs"), *largest))
    return spots, _cells(spots)


def _cells(spots: DataFrame) -> DataFrame:
    """What the spots, or rows that count ``n`` each, of a cell amount to."""
    edges = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon", "unc") for n, f in (("least", F.min), ("most", F.max))]
    cells = spots.groupBy(*_CELL).agg(F.sum("n").alias("n"), F.min("obs").alias("one"), *edges)
    return saved(cells.withColumn("cell", F.monotonically_increasing_id()))


def _cell_pairs(cells: DataFrame, radius_m: float, itself: bool = False) -> DataFrame:
    """``x, y`` (records of cells) and ``all``: each pair of cells that may hold rows within reach once, and whether all their rows are.

    A cell of several rows is a pair with ``itself`` where that is asked for.

    A cell reaches as far as its poorest fix and the box around its spots. All
    rows are within reach where the farthest corners of both boxes are, for the
    better fixes of each; boxes on both sides of the date line are not judged so.
    """
    nearest = F.when((F.col("least_lat") <= 0) & (F.col("most_lat") >= 0), F.lit(0.0)).otherwise(F.least(F.abs("least_lat"), F.abs("most_lat")))
    boxes = cells.withColumn("widest", F.cos(F.radians(nearest)))
    half = EARTH_RADIUS_M * 0.5 * (F.radians(F.col("most_lat") - F.col("least_lat")) + F.radians(F.col("most_lon") - F.col("least_lon")) * F.col("widest"))
    middle = [((F.col(f"least_{c}") + F.col(f"most_{c}")) / 2).alias(c) for c in ("lat", "lon")]
    record = F.struct("cell", "one", "n", "widest", *[f"{n}_{c}" for c in ("lat", "lon", "unc") for n in ("least", "most")])
    located = boxes.select(F.col("cell").alias("obs"), F.col("_cls").alias("cls"), *middle, (F.col("most_unc") + 2 * half + 1e-3).alias("unc"), record.alias("record"))
    pairs = _pairs(located, radius_m, "record")
    if itself:
        pairs = pairs.unionByName(located.filter("record.n > 1").select(F.col("record").alias("x"), F.col("record").alias("y")))
    apart = {c: F.greatest(F.col(f"x.most_{c}") - F.col(f"y.least_{c}"), F.col(f"y.most_{c}") - F.col(f"x.least_{c}")) for c in ("lat", "lon")}
    across = F.pow(F.sin(F.radians(apart["lat"]) / 2), 2) + F.col("x.widest") * F.col("y.widest") * F.pow(F.sin(F.radians(apart["lon"]) / 2), 2)
    farthest = 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(across)))
    within = (apart["lon"] <= 180) & (farthest + 1e-6 <= radius_m + 0.5 * (F.col("x.least_unc") + F.col("y.least_unc")))
    return pairs.select("x", "y", within.alias("all"))


def _met_spots(pairs: DataFrame, spots: DataFrame, cells: DataFrame, radius_m: float) -> DataFrame:
    """Spots (``x_`` and ``y_`` columns) of two cells each, ``pairs`` of ``x, y`` records, that are within reach of each other."""
    inside = spots.join(cells.select(*_CELL, "cell"), [*_CELL])
    side = lambda p: inside.select(F.col("cell").alias(f"{p}_cell"), *[F.col(c).alias(f"{p}_{c}") for c in ("lat", "lon", "unc", "n")])
    met = pairs.select(F.col("x.cell").alias("x_cell"), F.col("x.one").alias("x_one"), F.col("y.cell").alias("y_cell"), F.col("y.one").alias("y_one")).join(side("x"), "x_cell").join(side("y"), "y_cell")
    return met.filter(haversine_m(F.col("x_lat"), F.col("x_lon"), F.col("y_lat"), F.col("y_lon")) <= radius_m + 0.5 * (F.col("x_unc") + F.col("y_unc")))


def _cell_links(spots: DataFrame, cells: DataFrame, radius_m: float) -> DataFrame:
    """``a, b``: the least rows of cells that a pair of their rows connects; spots are looked at only where not all pairs do."""
    pairs = _cell_pairs(cells, radius_m)
    sure = pairs.filter("all").select(F.col("x.one").alias("a"), F.col("y.one").alias("b"))
    other = _met_spots(pairs.filter("not all"), spots, cells, radius_m).select(F.col("x_one").alias("a"), F.col("y_one").alias("b"))
    return sure.unionByName(other).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


#: Rows of a cell that go into one block, about.
BLOCK = 1024


def geographic_edges(obs: DataFrame, radius_m: float = 12.0, class_aware: bool = True) -> DataFrame:
    """``a, b`` (a before b) of observations (``obs, cls, lat, lon, unc``) whose distance is at most the radius and half their uncertainties.

    The pairs grow with the square of the rows at a place. Rows of a small cell
    go into blocks by a hash of their identifiers, and each row meets the blocks
    of its own cell and of those near it, a block being one array. So what a
    task holds is bounded, many tasks share a crowded place, and no pair is
    shuffled. Distances are worked out only where the boxes of two cells don't
    tell that all their rows are within reach. Rows without a position or a
    class are in no pair; a missing uncertainty counts as 0.
    """
    placed = _in_cells(obs.filter("obs is not null and lat is not null and lon is not null"), radius_m, class_aware)
    cells = _cells(_known(placed).withColumn("n", F.lit(1)))
    blocks = lambda n: F.ceil(n / BLOCK)
    rows = placed.select("obs", *_CELL, "lat", "lon", F.coalesce("unc", F.lit(0.0)).alias("unc")).join(cells.select(*_CELL, "cell", "n"), [*_CELL])
    rows = rows.select("cell", F.pmod(F.xxhash64("obs"), blocks(F.col("n"))).alias("block"), "obs", "lat", "lon", "unc")
    met = _cell_pairs(cells, radius_m, itself=True).select("all", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "xy" for c in ("cell", "n")])
    for p in "xy":
        met = met.withColumn(f"{p}_block", F.explode(F.sequence(F.lit(0), blocks(F.col(f"{p}_n")) - 1)))
    same = (F.col("x_cell") == F.col("y_cell")) & (F.col("x_block") == F.col("y_block"))
    met = met.filter("x_cell <> y_cell or x_block <= y_block").select("x_cell", "x_block", "y_cell", "y_block", "all", same.alias("same"))
    x = rows.select(F.col("cell").alias("x_cell"), F.col("block").alias("x_block"), "obs", "lat", "lon", "unc")
    y = rows.groupBy(F.col("cell").alias("y_cell"), F.col("block").alias("y_block")).agg(F.collect_list(F.struct("obs", "lat", "lon", "unc")).alias("rows"))
    # Few rows become many pairs here, so the number of tasks is not left to the size of what they read.
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = met.join(x, ["x_cell", "x_block"]).drop("x_cell", "x_block").repartition(parts, "y_cell", "y_block")
    both = asked.join(y.hint("merge"), ["y_cell", "y_block"]).select("all", "same", "obs", "lat", "lon", "unc", F.explode("rows").alias("o"))
    near = haversine_m(F.col("lat"), F.col("lon"), F.col("o.lat"), F.col("o.lon")) <= radius_m + 0.5 * (F.col("unc") + F.col("o.unc"))
    once = F.when(F.col("same"), F.col("obs") < F.col("o.obs")).otherwise(F.col("obs") != F.col("o.obs"))
    return both.filter(once & (F.col("all") | near)).select(F.least("obs", "o.obs").alias("a"), F.greatest("obs", "o.obs").alias("b"))


def geographic_links(obs: DataFrame, radius_m: float = 12.0, class_aware: bool = True) -> DataFrame:
    """Links that connect what ``geographic_edges`` connects, without the pairs among rows close together.

    Rows of one class in a small cell are all linked to the least of them;
    cells that a pair connects are linked once.
    """
    placed = _in_cells(obs, radius_m, class_aware)
    spots, cells = _spots(placed)
    inside = placed.select("obs", *_CELL).join(cells.select(*_CELL, "one"), [*_CELL]).filter("obs <> one")
    return _cell_links(spots, cells, radius_m).unionByName(inside.select(F.col("one").alias("a"), F.col("obs").alias("b")))


def _clusters_of_cells(spots: DataFrame, cells: DataFrame, radius_m: float) -> DataFrame:
    """``_CELL, cluster``: the least row that each cell is connected to."""
    found = components(cells.select(F.col("one").alias("obs")), _cell_links(spots, cells, radius_m))
    return saved(cells.select(*_CELL, "one").join(found.select(F.col("obs").alias("one"), "cluster").distinct(), "one").select(*_CELL, "cluster"))


def geographic_neighbours(obs: DataFrame, radius_m: float = 12.0, class_aware: bool = True) -> DataFrame:
    """``obs, cluster, links`` of every row: the least observation it is connected to, and with how many others it makes a pair of ``geographic_edges``.

    The pairs are not made where cells tell their number: all rows in a small
    cell are within reach of each other, and all of two cells where the
    farthest corners are. Spots are compared only between other cells that are
    near each other. Rows without a class or a position have no link; rows of
    one identifier are rows of their own.
    """
    placed = _in_cells(obs, radius_m, class_aware)
    spots, cells = _spots(placed, "unc")
    pairs = saved(_cell_pairs(cells, radius_m))
    pairs = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "all"))
    sure = pairs.filter("all").groupBy(F.col("x.cell").alias("cell")).agg(F.sum("y.n").alias("sure"))
    far = _met_spots(pairs.filter("not all"), spots, cells, radius_m).groupBy(*[F.col(f"x_{c}").alias(c) for c in ("cell", "lat", "lon", "unc")]).agg(F.sum("y_n").alias("far"))
    of_cell = cells.select("cell", *_CELL, F.col("n").alias("_all")).join(sure, "cell", "left").join(_clusters_of_cells(spots, cells, radius_m), [*_CELL])
    counted = spots.join(of_cell, [*_CELL]).join(far, ["cell", "lat", "lon", "unc"], "left")
    links = F.col("_all") - 1 + F.coalesce("sure", F.lit(0)) + F.coalesce("far", F.lit(0))
    known = saved(counted.select(*_CELL, "lat", F.col("lon").alias("_lon"), F.col("unc").alias("_unc"), "cluster", links.alias("links")))
    rows = placed.withColumns({"_lon": F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180, "_unc": F.coalesce("unc", F.lit(0.0))})
    return rows.join(known, [*_CELL, "lat", "_lon", "_unc"], "left").select("obs", F.coalesce("cluster", "obs").alias("cluster"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def sequence_edges(obs: DataFrame, gap: int = 3, least_iou: float = 0.20, class_aware: bool = True) -> DataFrame:
    """``a, b`` of observations whose boxes overlap, ``b`` behind ``a`` in the order of ``obs`` and 0 to ``gap`` frames after it.

    Frames go to buckets of gap + 1, each of which meets itself and the next.
    """
    box = ("obs", "cls", "frame_index", "x0", "y0", "x1", "y1")
    bucket = F.floor(F.col("frame_index") / (gap + 1))
    left = obs.select(*[F.col(c).alias(f"a_{c}") for c in box], F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    right = obs.select(*[F.col(c).alias(f"b_{c}") for c in box], bucket.alias("bucket"))
    same = left["bucket"] == right["bucket"]
    met = left.join(right, same & (F.col("a_cls") == F.col("b_cls")) if class_aware else same)
    pairs = met.filter((F.col("a_obs") < F.col("b_obs")) & (F.col("b_frame_index") - F.col("a_frame_index")).between(0, gap))
    return pairs.filter(iou("a_", "b_") >= least_iou).select(F.col("a_obs").alias("a"), F.col("b_obs").alias("b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``obs, cluster``: each observation with the least one it is connected to.

    In a round every node goes over to the neighbour, or itself, that has the
    least hash of all around it, then to that one's own choice, and links are
    drawn between where their ends went; what is inside one node is gone. So
    tables shrink from round to round, chains too, whatever order they have.
    The way back gives each node its end, and an end its least observation.
    """
    chosen = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("o"))
    own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("o"))
    # Each link once, so tables are half as large.
    links = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = checkpoint(both.groupBy("a").agg(F.min(chosen).alias("least")).select("a", F.least("least", own)["o"].alias("to")))
        went = checkpoint(choice.join(choice.select(F.col("a").alias("to"), F.col("to").alias("then")), "to").select("a", F.col("then").alias("to")))
        rounds.append(went)
        moved = links.join(went, "a").select(F.col("to").alias("a"), "b").join(went.select(F.col("a").alias("b"), F.col("to").alias("c")), "b").select("a", F.col("c").alias("b"))
        links = checkpoint(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return nodes.select("obs", F.col("obs").alias("cluster"))
    ends = rounds.pop()
    while rounds:
        went = rounds.pop()
        ends = checkpoint(went.join(ends.select(F.col("a").alias("to"), F.col("to").alias("end")), "to", "left").select("a", F.coalesce("end", "to").alias("to")))
    least = ends.groupBy("to").agg(F.min("a").alias("cluster"))
    found = ends.join(least, "to").select(F.col("a").alias("obs"), F.col("cluster").alias("_linked"))
    return nodes.select("obs").join(found, "obs", "left").select("obs", F.coalesce("_linked", "obs").alias("cluster"))


def association_mode(obs: DataFrame) -> str:
    """How observations can be told apart: "geographic" if all have a position, "sequence" if none has, else "mixed"."""
    n, located = obs.agg(F.count(F.lit(1)), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull())).first()
    return "geographic" if located == n else "mixed" if located else "sequence"


def associated(obs: DataFrame, radius_m: float = 12.0, gap: int = 3, least_iou: float = 0.20, class_aware: bool = True) -> tuple[DataFrame, str]:
    """(the rows with their ``cluster``, mode): positions decide where every observation has one; otherwise overlap in neighbouring frames decides for all.

    The choice is one aggregate. A survey of which some rows have no position
    goes by the sequence as a whole, so that two ways of telling don't mix.
    """
    mode = association_mode(obs)
    if mode != "geographic":
        return obs.join(components(obs, sequence_edges(obs, gap, least_iou, class_aware)), "obs"), mode
    # Cells stand for their rows, whose number the rounds then don't feel; a row finds its cluster by its cell.
    placed = _in_cells(obs.filter("obs is not null"), radius_m, class_aware)
    of_cell = _clusters_of_cells(*_spots(placed), radius_m)
    # Rows without a class are in no pair, so each stands alone.
    return placed.join(of_cell, [*_CELL], "left").withColumn("cluster", F.coalesce("cluster", "obs")).drop(*_CELL), mode


def associate(obs: DataFrame, radius_m: float = 12.0, gap: int = 3, least_iou: float = 0.20, class_aware: bool = True) -> tuple[DataFrame, str]:
    """``associated`` with ``obs, cluster`` only."""
    member, mode = associated(obs, radius_m, gap, least_iou, class_aware)
    return member.select("obs", "cluster"), mode


def steady_mean(column: str) -> Column:
    """The mean to a billionth, from a sum of whole billionths: the same in whatever order rows are added."""
    return F.sum(F.rint(F.col(column) * 1e9).cast("long")) / F.count(column) / 1e9


#: What an observation may bring along for its hazard's record, where it is the best one.
EVIDENCE = ("raw", "quality", "calibrated", "reason", "shadow_ratio", "texture_homogeneity", "method")


def rollup(obs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``rollup_members`` of observations whose clusters are a table of their own."""
    return rollup_members(obs.join(clusters, "obs"))


def rollup_members(member: DataFrame) -> DataFrame:
    """One row per ``cluster``: counts, confidences, mean position and its spread, uncertainty, mean box and the best member.

    Averaging n fixes lowers the uncertainty by the root of n, down to a half.
    A position is the mean of the members that have one. Columns of EVIDENCE
    that the rows have go with the best member. Figures are added up in a first
    pass; the next one looks for the rows that they name, which are few. Spread
    and frames are left joins behind that, which Spark leaves out where neither
    is asked for.
    """
    brought = [c for c in EVIDENCE if c in member.columns]
    total = saved(
        member.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("observation_count"),
            F.max("confidence").alias("best_confidence"),
            steady_mean("confidence").alias("mean_confidence"),
            steady_mean("lat").alias("lat"),
            steady_mean("lon").alias("lon"),
            F.count("lat").alias("_located"),
            F.avg("unc").alias("_unc"),
            F.count("unc").alias("_fixes"),
            F.avg(F.col("x1") - F.col("x0")).alias("width_px"),
            F.avg(F.col("y1") - F.col("y0")).alias("height_px"),
            F.min("obs").alias("_first"),
        )
    )
    named = member.join(total.select("cluster", F.col("best_confidence").alias("_best"), "_first"), "cluster").filter(F.col("confidence").eqNullSafe(F.col("_best")) | (F.col("obs") == F.col("_first")))
    best = F.max_by(F.struct("obs", "cls", "frame_index", "x0", "y0", "x1", "y1", *brought), F.struct("confidence", -F.col("obs")))
    first = F.min_by(F.struct("frame_index", "x0"), "obs")
    shown = named.groupBy("cluster").agg(best.alias("best"), first.alias("first"))
    frames = member.select("cluster", "frame_index").filter("frame_index is not null").distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("frame_index")).alias("frames"))
    centre = total.filter("_located > 1").select("cluster", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    far = member.join(centre, "cluster").groupBy("cluster").agg(F.max(haversine_m(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))).alias("spread_m"))
    out = saved(total.join(shown, "cluster").withColumn("unc", F.greatest(F.col("_unc") / F.sqrt("_fixes"), F.col("_unc") * 0.5)).drop("_located", "_unc", "_fixes", "_first"))
    none = F.array().cast(frames.schema["frames"].dataType)
    return out.join(far, "cluster", "left").join(frames, "cluster", "left").withColumn("frames", F.coalesce("frames", none))


def number(hazards: DataFrame, prefix: str = "HAZ") -> DataFrame:
    """Adds ``hazard_id`` in the order of each cluster's first member: by frame, then by its left edge.

    Rows are ranked inside ranges of the order, and each range starts where
    the one before it ended, so no task sorts all of them.
    """
    parts = hazards.sparkSession.conf.get("spark.sql.shuffle.partitions")
    key = ["frame_index", "x0", "cluster"]
    ranged = saved(hazards.select("first.frame_index", "first.x0", "cluster").repartitionByRange(int(parts), *key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").count().withColumn("_ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*key))).join(F.broadcast(starts), "_part")  # one row a partition
    return hazards.join(ranked.select("cluster", F.format_string(f"{prefix}-%05d", F.col("_k") + F.col("_ahead")).alias("hazard_id")), "cluster")
