"""The stored surveys, runs and hazards as tables, and the queries over them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import checkpoint


def list_surveys(surveys: DataFrame, runs: DataFrame) -> DataFrame:
    """Each survey with its number of runs."""
    counted = runs.groupBy("survey_id").agg(F.countDistinct("run_id").alias("runs"))
    return surveys.join(counted, "survey_id", "left").na.fill(0, ["runs"])


def survey_with_runs(surveys: DataFrame, runs: DataFrame, survey_id: int | None = None) -> DataFrame:
    """Surveys with their runs nested, latest first; one survey if ``survey_id`` is given."""
    if survey_id is not None:
        surveys, runs = surveys.filter(F.col("survey_id") == survey_id), runs.filter(F.col("survey_id") == survey_id)
    nested = runs.groupBy("survey_id").agg(F.sort_array(F.collect_list(F.struct("started", "run_id", "seconds")), asc=False).alias("runs"))
    return surveys.join(nested, "survey_id", "left")


def list_hazards(hazards: DataFrame, least_priority: float = 0.0, survey_id: int | None = None, run_id: int | None = None, band: str | None = None, located_only: bool = False, limit: int = 500) -> DataFrame:
    """The hazards that pass the given conditions, highest priority first, at most ``limit``."""
    out = hazards.filter(F.col("priority") >= least_priority)
    for column, value in (("survey_id", survey_id), ("run_id", run_id), ("band", band)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if located_only:
        out = out.filter("lat is not null")
    return out.orderBy(F.desc("priority"), "hazard_id").limit(limit)


def run_with_hazards(runs: DataFrame, hazards: DataFrame, run_id: int) -> DataFrame:
    """One run and its hazards, nested by falling priority."""
    own = hazards.filter(F.col("run_id") == run_id)
    nested = own.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("o"), "hazard_id", "priority", "band"))), lambda h: h.dropFields("o")).alias("hazards"))
    return runs.filter(F.col("run_id") == run_id).join(nested, "run_id", "left")


def stats(surveys: DataFrame, runs: DataFrame, hazards: DataFrame) -> DataFrame:
    """Counts of the store in one row."""
    of_hazards = hazards.agg(F.count(F.lit(1)).alias("hazards"), F.count("lat").alias("geolocated_hazards"), F.count_if(F.col("band").isin("HIGH", "URGENT")).alias("high_priority"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(surveys, "surveys").crossJoin(one(runs, "runs")).crossJoin(of_hazards)  # one row each


def upsert(table: DataFrame, new: DataFrame, keys: list[str], latest: str, keep_old: bool = False) -> DataFrame:
    """``table`` with ``new`` rows put in: the latest row of each key stays, or the one already there with ``keep_old``."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct(-F.col("_new"), F.col(latest)) if keep_old else F.struct("_new", latest)
    rows = [c for c in table.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rows), order).alias("_row")).select(*keys, "_row.*")


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each ``key``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def ranked(df: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``rank``, from 1 in the order of ``key``, and ``n``, the number of rows.

    Rows are ranked inside ranges of the order, and each range starts where
    the one before it ended, so no task sorts all of them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(df.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range from here on.
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"), F.sum("_size").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("_part").orderBy(*key)
    return ranged.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(starts), "_part").withColumn("rank", F.col("rank") + F.col("_ahead")).drop("_part", "_ahead")


def leaks(df: DataFrame, group: str, split: str, splits: list[str]) -> DataFrame:
    """One row: ``leaked``, the groups that are in more than one of ``splits``, and a count named ``a_b`` for each pair of them."""
    per = df.groupBy(group).agg(*[F.max(F.col(split) == s).alias(f"_{s}") for s in splits])
    several = sum(F.coalesce(F.col(f"_{s}"), F.lit(False)).cast("int") for s in splits) > 1
    return per.agg(F.count_if(several).alias("leaked"), *[F.count_if(F.col(f"_{a}") & F.col(f"_{b}")).alias(f"{a}_{b}") for a, b in combinations(splits, 2)])


def undeclared_navigation(scenarios: DataFrame, head: int = 400) -> DataFrame:
    """``scenario, reason``: scenarios that don't say what their navigation and licence are, or whose made-up navigation isn't labelled.

    ``scenarios`` has ``scenario, navigation, license, synthetic`` and
    ``track``, the text of the navigation file or null. A track must be marked
    both by ``synthetic`` and by the word in its first ``head`` characters.
    """
    marked = F.upper(F.substring("track", 1, head)).contains("SYNTHETIC")
    reason = (
        F.when(F.col("navigation").isNull(), "no navigation status").when(F.col("license").isNull(), "no license")
        .when(F.col("track").isNotNull() & ~F.coalesce("synthetic", F.lit(False)), "not declared synthetic").when(F.col("track").isNotNull() & ~marked, "track not labelled")
    )
    return scenarios.select("scenario", reason.alias("reason")).filter("reason is not null")
