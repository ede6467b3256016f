"""Queries over stored runs, splits, sets and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.numbers import micro
from fathomline.operators import images as I
from fathomline.operators import store as S
from fathomline.plans.registry import query
from fathomline.plans.views import micro_sql, read
from fathomline.session import shared_folder
from fathomline.sources import models
from fathomline.sources import writers as W


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("survey_id"), F.col("c_name").alias("name"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("survey_id"), F.col("o_orderdate").alias("started"), (F.col("o_totalprice") / 1000).alias("seconds"))


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'")
    priority = F.col("l_extendedprice") / 1050
    band = F.when(priority >= 75, "URGENT").when(priority >= 55, "HIGH").when(priority >= 35, "ELEVATED").otherwise("ROUTINE")
    return line.select(
        F.col("l_extendedprice").alias("hazard_id"), F.col("l_orderkey").alias("run_id"), priority.alias("priority"), band.alias("band"), F.col("l_returnflag").alias("level2"),
        F.when(F.col("l_returnflag") != "R", F.lit(12.9) + (F.col("l_partkey") % 100) * 1e-3).alias("lat"),
    )


_VIEWS = """surveys AS (SELECT c_custkey AS survey_id, c_name AS name FROM customer),
runs AS (SELECT o_orderkey AS run_id, o_custkey AS survey_id, o_orderdate AS started, o_totalprice / 1000 AS seconds FROM orders),
hazards AS (SELECT l_extendedprice AS hazard_id, l_orderkey AS run_id, l_extendedprice / 1050 AS priority, CASE WHEN l_extendedprice / 1050 >= 75 THEN 'URGENT'
    WHEN l_extendedprice / 1050 >= 55 THEN 'HIGH' WHEN l_extendedprice / 1050 >= 35 THEN 'ELEVATED' ELSE 'ROUTINE' END AS band, l_returnflag AS level2,
    CASE WHEN l_returnflag <> 'R' THEN 12.9::DOUBLE + (l_partkey % 100) * 1e-3::DOUBLE END AS lat FROM lineitem WHERE l_linestatus = 'F')"""


@query(f"WITH {_VIEWS} SELECT s.survey_id, any_value(s.name) AS name, count(DISTINCT r.run_id) AS runs FROM surveys s LEFT JOIN runs r USING (survey_id) GROUP BY s.survey_id")
def list_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, JN8, AG16, SL3: surveys with their runs counted."""
    return S.list_surveys(surveys(spark, sf_dir), runs(spark, sf_dir))


@query(f"""WITH {_VIEWS} SELECT s.survey_id, s.name, string_agg(r.run_id::VARCHAR, ',' ORDER BY r.started DESC, r.run_id DESC) AS runs FROM surveys s LEFT JOIN runs r USING (survey_id) GROUP BY ALL""")
def survey_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, JN9: surveys with their runs nested, shown as a list."""
    nested = S.survey_with_runs(surveys(spark, sf_dir), runs(spark, sf_dir))
    return nested.select("survey_id", "name", F.array_join(F.transform("runs", lambda r: r["run_id"].cast("string")), ",").alias("runs"))


@query(f"WITH {_VIEWS} SELECT hazard_id, run_id, band, {micro_sql('priority')} AS priority FROM hazards WHERE priority >= 40 AND band = 'HIGH' AND lat IS NOT NULL ORDER BY hazards.priority DESC, hazard_id, run_id LIMIT 500")
def list_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, FLT1, FLT6, SL1: hazards by conditions, highest priority first."""
    found = hazards(spark, sf_dir).filter("priority >= 40 and band = 'HIGH' and lat is not null").orderBy(F.desc("priority"), "hazard_id", "run_id").limit(500)
    return found.select("hazard_id", "run_id", "band", micro(F.col("priority")).alias("priority"))


@query(f"WITH {_VIEWS} SELECT hazard_id, max(run_id) AS run_id, arg_max(band, run_id) AS band FROM hazards GROUP BY hazard_id")
def latest_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, WN11: each hazard as the latest run has it."""
    return hazards(spark, sf_dir).groupBy("hazard_id").agg(F.max("run_id").alias("run_id"), F.max_by("band", "run_id").alias("band"))


@query(f"WITH {_VIEWS} SELECT r.run_id, r.survey_id, string_agg(floor(h.hazard_id)::BIGINT::VARCHAR, ',' ORDER BY h.priority DESC, h.hazard_id) AS hazards FROM runs r JOIN hazards h USING (run_id) GROUP BY ALL")
def run_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5, JN10: runs with their hazards nested by falling priority, shown as a list."""
    nested = hazards(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("o"), "hazard_id"))).alias("h"))
    listed = F.array_join(F.transform("h", lambda h: h["hazard_id"].cast("long").cast("string")), ",")
    return runs(spark, sf_dir).join(nested, "run_id").select("run_id", "survey_id", listed.alias("hazards"))


@query(f"WITH {_VIEWS} SELECT (SELECT count(*) FROM surveys) AS surveys, (SELECT count(*) FROM runs) AS runs, count(*) AS hazards, count(lat) AS geolocated_hazards, count_if(band IN ('HIGH', 'URGENT')) AS high_priority FROM hazards")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, AG17: counts of the store."""
    return S.stats(surveys(spark, sf_dir), runs(spark, sf_dir), hazards(spark, sf_dir))


_NEW = "new AS (SELECT o_custkey AS survey_id, 'run ' || o_orderstatus || o_orderkey AS name, o_orderkey AS seq FROM orders WHERE o_custkey % 3 = 0)"


def _new_surveys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = surveys(spark, sf_dir).withColumn("seq", F.lit(0).cast("long"))
    o = read(spark, sf_dir, "orders").filter("o_custkey % 3 = 0")
    return old, o.select(F.col("o_custkey").alias("survey_id"), F.concat(F.lit("run "), "o_orderstatus", F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {_VIEWS}, {_NEW}, every AS (SELECT survey_id, name, 0 AS seq FROM surveys UNION ALL FROM new) SELECT survey_id, arg_max(name, seq) AS name, max(seq)::BIGINT AS seq FROM every GROUP BY survey_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5, SNK6: rows put in by key, the latest wins."""
    old, new = _new_surveys(spark, sf_dir)
    return S.upsert(old, new, ["survey_id"], "seq")


@query(f"WITH {_VIEWS}, {_NEW} SELECT survey_id, name, 0::BIGINT AS seq FROM surveys UNION ALL SELECT survey_id, arg_max(name, seq), max(seq) FROM new WHERE survey_id NOT IN (SELECT survey_id FROM surveys) GROUP BY survey_id")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: rows put in by key, what is there stays."""
    old, new = _new_surveys(spark, sf_dir)
    return S.upsert(old, new, ["survey_id"], "seq", keep_old=True)


@query("SELECT user_id AS experiment, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def newest_per_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN9: the last entry of each experiment."""
    return S.newest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("experiment"), "event_id", "event_type", "ts")


@query("SELECT l_orderkey AS run_id, l_returnflag AS frame, count(*) AS n_raw, count_if(l_linestatus = 'F') AS n_accepted, count(*) - count_if(l_linestatus = 'F') AS n_rejected FROM lineitem GROUP BY ALL")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24, DQ5: raw, accepted and rejected detections of each frame."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("frame"))
    return line.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.expr("l_linestatus = 'F'")).alias("n_accepted"), F.count_if(F.expr("l_linestatus <> 'F'")).alias("n_rejected"))


@query("SELECT o_orderkey AS frame, extract(year FROM o_orderdate)::INTEGER AS year, CASE WHEN extract(year FROM o_orderdate) <= 1994 THEN 'train' WHEN extract(year FROM o_orderdate) = 1995 THEN 'val' ELSE 'test' END AS split FROM orders")
def split_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL8, ST3: splits by survey year."""
    year = F.year("o_orderdate")
    split = F.when(year <= 1994, "train").when(year == 1995, "val").otherwise("test")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), year.alias("year"), split.alias("split"))


@query("WITH s AS (SELECT o_custkey AS recording, row_number() OVER (ORDER BY md5(o_custkey::VARCHAR)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT recording, CASE WHEN k <= greatest(1, floor(n * 0.15)) THEN 'test' WHEN k <= greatest(1, floor(n * 0.15)) + greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM s")
def recording_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL7, SL9: a seeded shuffle of recordings by hash, cut into splits of exact size."""
    recordings = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording")).distinct().withColumn("h", F.md5(F.col("recording").cast("string").cast("binary")))
    ranked = S.ranked(recordings, ["h", "recording"])
    part = F.greatest(F.lit(1), F.floor(F.col("n") * 0.15))
    split = F.when(F.col("rank") <= part, "test").when(F.col("rank") <= part + part, "val").otherwise("train")
    return ranked.select("recording", split.alias("split"))


@query(
    """WITH held AS (SELECT o_custkey, bool_or(o_orderkey % 4 > 1) AS train, bool_or(o_orderkey % 4 = 1) AS val, bool_or(o_orderkey % 4 = 0) AS test FROM orders GROUP BY o_custkey)
    SELECT count(*) FILTER (CAST(train AS INTEGER) + CAST(val AS INTEGER) + CAST(test AS INTEGER) > 1) AS leaked,
           count(*) FILTER (train AND val) AS train_val, count(*) FILTER (train AND test) AS train_test, count(*) FILTER (val AND test) AS val_test FROM held"""
)
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO2: recordings that are in more than one split, and those of each pair of splits."""
    r = F.col("o_orderkey") % 4
    split = F.when(r == 0, "test").when(r == 1, "val").otherwise("train")
    return S.leaks(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording"), split.alias("split")), "recording", "split", ["train", "val", "test"])


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO4: frames minus those with targets."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("SELECT DISTINCT l_returnflag || l_linestatus AS note FROM lineitem ORDER BY note LIMIT 12")
def distinct_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL10, SO3: the first dozen distinct notes."""
    return read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("note")).distinct().orderBy("note").limit(12)


@query("SELECT l_orderkey AS frame, l_extendedprice AS idx, 'clean' AS kind FROM lineitem UNION ALL SELECT l_orderkey, l_extendedprice, 'augmented' FROM lineitem WHERE l_orderkey % 4 > 1")
def union_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO1, SO5: clean frames and, for training only, augmented copies."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_extendedprice").alias("idx"))
    return line.withColumn("kind", F.lit("clean")).unionByName(line.filter("frame % 4 > 1").withColumn("kind", F.lit("augmented")))


@query("WITH reality AS (SELECT l_returnflag AS cls, count(*) AS n FROM lineitem GROUP BY 1), manifest(cls, n) AS (SELECT l_returnflag, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 1) SELECT cls, m.n AS listed, r.n AS counted FROM reality r JOIN manifest m USING (cls) WHERE m.n <> r.n")
def manifest_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ3: classes whose listed number is not what is there."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("cls"))
    return line.agg(F.countDistinct("l_orderkey").alias("listed"), F.count(F.lit(1)).alias("counted")).filter("listed <> counted")


@query("SELECT p_size * 40 AS width, p_size * 25 + 100 AS height, count(*) AS n FROM part GROUP BY ALL")
def shape_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: frames by shape."""
    p = read(spark, sf_dir, "part")
    return p.groupBy((F.col("p_size") * 40).alias("width"), (F.col("p_size") * 25 + 100).alias("height")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS1, JS2: known fields of stored JSON."""
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("p.k").isNotNull().alias("has_k"))


@query(
    """SELECT page_id, regexp_replace(lower(trim(url)), '[^a-z0-9_]', '', 'g') AS name, CASE WHEN contains(url, '_') THEN split_part(url, '_', 1) ELSE url END AS recording,
    regexp_extract(url, '([^/]*)$', 1) AS stem, coalesce(lower(nullif(regexp_extract(url, '(\\.[^./?#]+)$', 1), '')), '') AS suffix, regexp_matches(url, '^\\s*(#|;|//)') AS comment, replace(split_part(url, '.', 1), '_', ' ') AS label FROM pages"""
)
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2, ST4, ST7, ST8: names, recording keys, stems, suffixes and labels."""
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace(F.lower(F.trim(url)), "[^a-z0-9_]", "").alias("name"), F.substring_index(url, "_", 1).alias("recording"), F.regexp_extract(url, "([^/]*)$", 1).alias("stem"),
        F.lower(F.regexp_extract(url, r"(\.[^./?#]+)$", 1)).alias("suffix"), url.rlike(r"^\s*(#|;|//)").alias("comment"), F.replace(F.substring_index(url, ".", 1), F.lit("_"), F.lit(" ")).alias("label"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, 'RUN-' || lower(to_hex(epoch_us(ts) // 1000)) AS run_id FROM events")
def iso_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT1, DT2: times as ISO text, and run ids from milliseconds."""
    # Stored times carry no zone; they count as UTC, whatever zone the session is in.
    local = F.unix_millis(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) - F.unix_millis(F.to_utc_timestamp(F.lit("1970-01-01").cast("timestamp"), F.current_timezone()))
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"), F.concat(F.lit("RUN-"), F.lower(F.hex(local))).alias("run_id"))


@query(
    """WITH s AS (SELECT doc_id AS scenario, lang AS navigation, source AS license, toxic = 1 AS synthetic, nullif(text, '') AS track FROM documents LEFT JOIN labels USING (doc_id)),
    r AS (SELECT scenario, CASE WHEN navigation IS NULL THEN 'no navigation status' WHEN license IS NULL THEN 'no license' WHEN track IS NOT NULL AND NOT coalesce(synthetic, false) THEN 'not declared synthetic'
        WHEN track IS NOT NULL AND NOT contains(upper(substring(track, 1, 400)), 'SYNTHETIC') THEN 'track not labelled' END AS reason FROM s)
    SELECT scenario, reason FROM r WHERE reason IS NOT NULL"""
)
def undeclared_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ4: scenarios whose navigation is not declared; documents stand for navigation files."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("synthetic")), "doc_id", "left")
    return S.undeclared_navigation(docs.select(F.col("doc_id").alias("scenario"), F.col("lang").alias("navigation"), F.col("source").alias("license"), "synthetic", F.nullif("text", F.lit("")).alias("track")))


@query(
    """WITH l AS (SELECT l_orderkey AS frame, l_returnflag AS cls FROM lineitem), m AS (SELECT o_orderkey AS frame, CASE WHEN o_orderkey % 4 = 0 THEN 'test' WHEN o_orderkey % 4 = 1 THEN 'val' ELSE 'train' END AS split FROM orders),
    h AS (SELECT split, count(*) AS total_objects, count(DISTINCT frame) AS positive_frames, count_if(cls = 'A') AS a, count_if(cls = 'N') AS n, count_if(cls = 'R') AS r FROM l JOIN m USING (frame) GROUP BY split)
    SELECT split, frames, positive_frames, frames - positive_frames AS negative_frames, total_objects, 'A=' || a || ' N=' || n || ' R=' || r AS objects FROM h JOIN (SELECT split, count(*) AS frames FROM m GROUP BY split) USING (split)"""
)
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: what a data set's manifest says of each split."""
    r = F.col("o_orderkey") % 4
    frames = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.when(r == 0, "test").when(r == 1, "val").otherwise("train").alias("split"))
    found = W.split_manifest(frames, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("cls")))
    objects = F.array_join(F.transform(F.map_entries("objects"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return found.withColumn("objects", objects)


@query(
    """WITH r AS (SELECT 'E' || p_partkey AS experiment_id, p_size / 50 AS recall, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS notes FROM part UNION ALL SELECT 'F' || c_custkey, NULL, NULL FROM customer)
    SELECT experiment_id, recall, notes FROM r"""
)
def experiment_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7, SRC10: two batches of experiments, of different columns, appended to a registry of JSON lines and read again."""
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    first = read(spark, sf_dir, "part").select(F.concat(F.lit("E"), "p_partkey").alias("experiment_id"), (F.col("p_size") / 50).alias("recall"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("notes"))
    W.append_registry(first, path)
    W.append_registry(read(spark, sf_dir, "customer").select(F.concat(F.lit("F"), "c_custkey").alias("experiment_id")), path)
    return models.read_experiments(spark, path).select("experiment_id", "recall", "notes")


@query(
    """SELECT lang AS scenario, 'Scenario ' || lang AS title, count(*) AS frame_count, min('d' || lpad(doc_id::VARCHAR, 9, '0')) AS first_frame, max('d' || lpad(doc_id::VARCHAR, 9, '0')) AS last_frame,
    CASE WHEN lang = 'en' THEN 'SYNTHETIC - see navigation.csv header' ELSE 'none - geolocation will report UNAVAILABLE' END AS navigation, 'CC BY 4.0' AS license FROM documents GROUP BY lang"""
)
def scenario_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN2: descriptions of scenarios, written and read again; documents stand for frames and languages for scenarios."""
    path = f"{shared_folder(spark)}/scenarios-{uuid.uuid4().hex}"
    frames = read(spark, sf_dir, "documents").select(F.col("lang").alias("scenario"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("frame"))
    info = frames.select("scenario").distinct().select("scenario", F.concat(F.lit("Scenario "), "scenario").alias("title"), F.lit("CC BY 4.0").alias("license"), (F.col("scenario") == "en").alias("synthetic_navigation"))
    W.write_scenarios(W.scenarios(frames, info), path)
    back = spark.read.text(path).select("scenario", F.from_json("value", "title string, frame_count long, frames array<string>, navigation string, license string").alias("s"))
    return back.select("scenario", "s.title", "s.frame_count", F.get("s.frames", F.lit(0)).alias("first_frame"), F.element_at("s.frames", -1).alias("last_frame"), "s.navigation", "s.license")


@query("SELECT p_partkey AS id, ['none', 'standard', 'split', 'slant', 'blind', 'unknown'][p_size % 6 + 1] AS profile, p_size % 6 IN (0, 1, 4) AS safe FROM part")
def geometry_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT8: whether labels may be copied along with frames of a profile: not where it moves pixels, nor where nobody knows it."""
    profiles = {"none": "none", "standard": "standard", "split": I.Conditioning(band="split"), "slant": I.Conditioning(slant=True, altitude=4.0), "blind": I.Conditioning(slant=True), "unknown": "no such profile"}

    def safe(profile: str | I.Conditioning) -> bool:
        try:
            I.check_geometry_safe(profile)
        except ValueError:
            return False
        return True

    verdicts = F.create_map(*[F.lit(x) for name, profile in profiles.items() for x in (name, safe(profile))])
    named = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, profiles)), (F.col("p_size") % 6 + 1).cast("int")).alias("profile"))
    return named.withColumn("safe", verdicts[F.col("profile")])
