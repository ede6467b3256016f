"""Pipeline stages on odd, empty and clashing tables, and fits on repeated rows."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fathomline.llm.toxicity import fit_toxicity

NAMES = ("_key", "_id", "_h", "body", "id", "seed", "item", "spans", "digest", "rep", "component", "salt", "rank")
STAGES = corpus_pipeline.STAGES[:-1]


def rows(df, columns=("doc_id", "text")):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name,stage", STAGES)
def test_odd_rows(spark, sf_dir, odd, name, stage):
    """Nulls, empty and blank texts, ties, repeats, rows without identifier and long texts; what a stage drops is a copy or near copy."""
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = stage(spark, plain, sf_dir)
    assert kept.columns == plain.columns
    before, after = rows(plain), rows(kept)
    assert not after - before
    gone = before - after
    if name == "exact_dedup":
        assert Counter({t or "": n for t, n in Counter(t or "" for _, t in after.elements()).items()}) == Counter({t or "" for _, t in before})
    elif name == "ngram_join":
        assert set(gone) <= {(5, "One two three"), (6, "one two three"), (9, next(t for i, t in before if i == 9))} and gone
    else:
        assert not gone
    wide = plain.select("*", *[F.lit(f"of {n}").alias(n) for n in NAMES])
    wide_kept = stage(spark, wide, sf_dir)
    assert wide_kept.columns == wide.columns and rows(wide_kept) == after and all(r[n] == f"of {n}" for r in wide_kept.collect() for n in NAMES)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table(spark, sf_dir, empty, name, stage):
    assert stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), sf_dir).collect() == []


def test_fit_takes_one_row_of_an_identifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    again = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" and more"))))
    assert fit_toxicity(again, labels).weights == fit_toxicity(docs, labels).weights
