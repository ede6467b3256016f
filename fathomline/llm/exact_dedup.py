"""Exact deduplication by a log-structured merge index, with DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import FILTER_BITS, Scratch, fresh, membership_filter, with_membership

#: Rows of one memtable; a table of several becomes several runs.
MEMTABLE_ROWS = 50_000
FAN_IN = 8
#: At most this many runs at a time have their filters compared; more rows make larger runs instead.
MOST_RUNS = 4096


def flush_runs(digests: DataFrame, scratch: Scratch, rows: int, memtable_rows: int = MEMTABLE_ROWS) -> tuple[DataFrame, int]:
    """Memtables of about ``memtable_rows`` rows, each flushed as a run sorted by digest.

    A row's memtable follows from its identifier, so a lost task writes the
    same run again. Copies inside a memtable collapse before the shuffle.
    """
    runs = max(1, min(MOST_RUNS, -(-rows // memtable_rows)))
    entry = (
        digests.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)))
        .groupBy("run", "digest")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    )
    return scratch.table(entry.sortWithinPartitions("run", "digest")), runs


def in_several_runs(entries: DataFrame) -> DataFrame:
    """A filter of what is set in the filters of two runs or more; a digest that misses it is in one run only.

    A run's filter is the set of bits of its digests, so the runs that share
    a bit are counted; the result is one bitmap of at most 1 MB.
    """
    bits = entries.select("run", F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).alias("bit")).distinct()
    return membership_filter(bits.groupBy("bit").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1"), "bit")


def compact(entries: DataFrame, scratch: Scratch, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merges ``fan_in`` runs at a time until one is left, keeping the least and greatest identifier.

    Digests that the filters show in one run only are final as they are and
    pass by the merge; the others alone are shuffled.
    """
    done: list[DataFrame] = []
    while runs > 1:
        probed = scratch.table(with_membership(entries, F.xxhash64("digest"), in_several_runs(entries), "maybe"))
        scratch.drop(entries)
        done.append(probed.filter(~F.col("maybe")).drop("maybe", "run"))
        runs = -(-runs // fan_in)
        merged = probed.filter("maybe").withColumn("run", F.col("run") % F.lit(runs)).groupBy("run", "digest")
        entries = scratch.table(merged.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")))
    return reduce(DataFrame.unionByName, done, entries.drop("run"))


def lsm_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty. ``keep`` names
    the row of each group that stays: "smallest" or "largest" identifier. A row
    without an identifier counts in its group and stays only if no row of the
    group has one. Rows repeated with one identifier get the same answer. An
    empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    digests = scratch.table(source.select("id", F.unhex(F.sha2("body", 256)).alias("digest")))
    entries, runs = flush_runs(digests, scratch, digests.count(), memtable_rows)
    index = scratch.table(compact(entries, scratch, runs))

    hits = index.filter("n > 1")
    verified = scratch.table(byte_classes(source, hits))
    split = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    chosen = "low" if keep == "smallest" else "high"
    # One text to a digest: the index row stands, as its bytes were compared.
    sound = index.join(split, "digest", "left_anti").select("digest", F.col(chosen).alias("keep_id"), F.col("n").alias("group_size"))
    result = digests.join(sound, "digest").select("id", "digest", "keep_id", "group_size")
    if not split.isEmpty():
        # Two texts under one digest: those few groups are told apart by their bytes.
        apart = source.withColumn("digest", F.unhex(F.sha2("body", 256))).join(split, "digest", "left_semi")
        named = verified.join(split, "digest", "left_semi").select("digest", F.col("body").alias("_text"), F.col(chosen).alias("keep_id"), F.col("n").alias("group_size"))
        result = result.unionByName(apart.join(named, (apart["digest"] == named["digest"]) & (apart["body"] == named["_text"])).select("id", apart["digest"], "keep_id", "group_size"))
    return result.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def byte_classes(source: DataFrame, hits: DataFrame) -> DataFrame:
    """The classes of equal bytes among the rows whose digest is a hit.

    Only rows that pass the filter over the hits carry their text into the
    shuffle, and copies in one task collapse before it, so that a group of a
    third of all rows sends one row from each task. ``body`` is the text where
    a digest has several, else null.
    """
    bitmap = membership_filter(hits.select(F.xxhash64("digest").alias("key")), "key")
    probed = source.withColumn("digest", F.unhex(F.sha2("body", 256)))
    probed = with_membership(probed, F.xxhash64("digest"), bitmap, "maybe").filter("maybe")
    classes = probed.groupBy("digest", "body").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    per_digest = classes.groupBy("digest").agg(F.collect_list(F.struct("low", "high", "n", "body")).alias("texts"))
    one = F.size("texts") == 1
    return (
        per_digest.join(hits.select("digest"), "digest", "left_semi")
        .select("digest", F.when(one, F.transform("texts", lambda t: t.withField("body", F.lit(None).cast("string")))).otherwise(F.col("texts")).alias("texts"))
        .select("digest", F.inline("texts"))
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group of equal texts.

    Only rows of groups with copies are joined; all others pass by the filter
    without a shuffle. Rows repeated with one identifier and text leave one.
    """
    scratch = Scratch(docs.sparkSession, "exact-drop")
    decided = lsm_dedup(docs, id_col, text_col, keep, scratch=scratch).filter("group_size > 1")
    owner, digest, maybe, hit = fresh(docs.columns, "_owner", "_digest", "_maybe", "_hit")
    decided = scratch.table(decided.select(F.col(id_col).alias(owner), F.col("text_sha256").alias(digest), "kept"))
    scratch.keep(decided)
    keepers = decided.filter("kept").select(owner, digest).distinct()
    bitmap = membership_filter(decided.select(F.xxhash64(digest).alias("key")), "key")
    marked = with_membership(docs.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), F.xxhash64(digest), bitmap, maybe)
    alone = marked.filter(~F.col(maybe)).select(docs.columns)
    several = marked.filter(maybe).join(decided.select(digest).distinct().withColumn(hit, F.lit(True)), digest, "left")
    fine = several.filter(F.col(hit).isNull()).select(docs.columns)
    kept = several.filter(hit).join(keepers, (F.col(id_col).eqNullSafe(F.col(owner))) & (several[digest] == keepers[digest]), "left_semi")
    return alone.unionByName(fine).unionByName(kept.dropDuplicates([id_col, digest]).select(docs.columns))
