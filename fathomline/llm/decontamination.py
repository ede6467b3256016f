"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, drop_ids, fresh, membership_filter, with_membership, with_row_key

#: Positions that a seed looks at; the others are ignored. Together they hit
#: every alignment of 8 to 24 words with at most a fifth of them substituted.
MASKS = ((0, 1, 2, 4), (0, 1, 3, 4), (0, 1, 2, 3))
LEAST_WORDS = 8
WINDOW_WORDS = 24
SIMILARITY = 0.8
#: Above this many test seeds they are joined by a shuffle instead of a broadcast (24 bytes a seed).
BROADCAST_SEEDS = 500_000


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each lower-cased word; words are split at space, tab and line ends."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """``array<struct<seed, at>>`` of every position of the word-hash array ``words`` and each mask that fits."""
    w = F.col(words)

    def of(number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(w) - (mask[-1] + 1)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit(number), *[F.get(w, i + o) for o in mask]).alias("seed"), i.alias("at")))

    parts = [of(number, mask) for number, mask in enumerate(masks)]
    return F.concat(*parts)


def contaminated(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    window: int = WINDOW_WORDS,
    least: int = LEAST_WORDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each document and test item that overlap: ``id_col, item_col, matches, overlap_words, similarity, item_words, start_word``.

    They overlap when, on some alignment without gaps, a stretch of the item of
    min(``window``, its length) words agrees with the document in at least
    ``similarity`` of the positions; so substituted words are tolerated.
    ``start_word`` is where the item's first word would be in the document.
    Test items under ``least`` words are too short to tell a leak from chance
    and match nothing, as do null and empty texts. Rows without an identifier
    are not reported. Repeated rows are reported once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    items = tests.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("item_hashes")).filter(F.size("item_hashes") >= least).dropDuplicates()
    items = scratch.table(items)
    probes = items.select("item", F.inline(seeds("item_hashes"))).withColumnRenamed("at", "item_at")
    probes = F.broadcast(probes) if probes.count() <= BROADCAST_SEEDS else probes

    hashed = docs.select(F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("hashes")).filter("id is not null")
    hits = hashed.select("id", F.inline(seeds("hashes"))).join(probes, "seed").select("id", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = scratch.table(hits)

    # Only documents with hits are hashed again and shuffled.
    bitmap = membership_filter(hits.select(F.xxhash64("id").alias("key")).distinct(), "key")
    hit_docs = with_membership(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), F.xxhash64("id"), bitmap, "maybe").filter("maybe")
    wanted = hits.groupBy("id").agg(F.collect_set(F.struct("item", "diagonal")).alias("found"))
    aligned = (
        hit_docs.join(wanted, "id")
        .select("id", word_hashes(F.col("body")).alias("hashes"), "found")
        .select("id", F.inline("found"), "hashes")
        .withColumn("size", F.size("hashes"))
    )
    # The stretch of the document under the item, null where the item sticks out.
    sized = aligned.join(items, "item")
    same = F.transform("item_hashes", lambda h, j: F.when(F.get("hashes", F.when(F.col("diagonal") + j >= 0, F.col("diagonal") + j)) == h, 1).otherwise(0))
    length = F.size("item_hashes")
    compared = sized.select("id", "item", "diagonal", same.alias("same"), length.alias("item_words"), F.least(length, F.lit(window)).alias("overlap_words"))
    starts = F.sequence(F.lit(1), F.col("item_words") - F.col("overlap_words") + 1)
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("same", s, F.col("overlap_words")), F.lit(0), lambda a, x: a + x)))
    judged = compared.select("id", "item", "diagonal", "item_words", "overlap_words", best.alias("matches"))
    leaks = judged.filter(F.col("matches") >= F.ceil(F.lit(similarity) * F.col("overlap_words") - 1e-9))
    top = leaks.groupBy("id", "item").agg(F.max_by(F.struct("matches", "overlap_words", "item_words", "diagonal"), F.struct("matches", -F.col("diagonal"))).alias("top"))
    return top.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("top.matches").alias("matches"),
        F.col("top.overlap_words").alias("overlap_words"),
        (F.col("top.matches") / F.col("top.overlap_words")).alias("similarity"),
        F.col("top.item_words").alias("item_words"),
        F.col("top.diagonal").alias("start_word"),
    )


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no passage with ``tests``; rows without an identifier are judged by none and stay.

    Where an identifier stands for several texts, each of them is judged alone.
    Null, empty and short texts share nothing and stay, as do all repeats of a
    clean row. Further columns pass unchanged, whatever their names; an empty
    table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "decontaminated")
    (key,) = fresh(docs.columns, "_key")
    keyed = with_row_key(docs, id_col, text_col, key)
    leaks = scratch.table(contaminated(keyed, tests, key, text_col, scratch=scratch, **options).select(key).distinct())
    scratch.keep(leaks)
    return drop_ids(keyed, key, leaks, key).select(docs.columns)
