"""Identifiers that are null or stand for several texts cost no text."""

from fathomline.llm.decontamination import drop_contaminated
from fathomline.llm.exact_dedup import drop_exact_copies
from fathomline.llm.ngram_join import drop_similar

LONG = [f"w{i}" for i in range(60)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_copies_without_identifier_keep_each_text(spark):
    docs = table(spark, [(None, "X"), (None, "X"), (None, "Y"), (None, "Y"), (7, "Z")])
    assert pairs(drop_exact_copies(docs)) == [(7, "Z"), (None, "X"), (None, "Y")]


def test_copies_that_share_an_identifier_keep_each_text(spark):
    docs = table(spark, [(1, "X"), (2, "X"), (1, "Y"), (3, "Y"), (1, "Y")])
    assert pairs(drop_exact_copies(docs)) == [(1, "X"), (1, "Y")]


def test_similar_texts_under_shared_identifiers(spark):
    a, near, other = " ".join(LONG), " ".join([*LONG, "tail"]), " ".join(w + "x" for w in LONG)
    # 2 is near to 1 with one of its texts only; 3 has two near texts; null stays.
    docs = table(spark, [(1, a), (2, near), (2, other), (3, "one two three four five six"), (3, "one two three four five six"), (None, a)])
    assert pairs(drop_similar(docs)) == sorted([(1, a), (2, other), (3, "one two three four five six"), (3, "one two three four five six"), (None, a)], key=repr)
    apart = table(spark, [(1, a), (2, near), (3, other)])
    assert pairs(drop_similar(apart)) == [(1, a), (3, other)]


def test_leaks_under_shared_identifiers(spark):
    leak, clean = " ".join(LONG), " ".join(w + "x" for w in LONG)
    docs = table(spark, [(1, leak), (1, clean), (2, clean), (None, leak)])
    tests = spark.createDataFrame([(1, " ".join(LONG[5:40]))], "item_id long, text string")
    assert pairs(drop_contaminated(docs, tests)) == sorted([(1, clean), (2, clean), (None, leak)], key=repr)
