"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Stages but the last keep the columns of ``documents``, whatever further ones
there are and whatever their names, and decide on whole rows and whole texts of
any length. Null and empty texts are clean and near to nothing, so they stay,
but for copies of each other; rows without identifier are never taken for
copies of others but by their text. An empty table gives an empty result
everywhere.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import Scratch, read
from fathomline.llm.decontamination import drop_contaminated
from fathomline.llm.exact_dedup import drop_exact_copies
from fathomline.llm.ngram_join import drop_similar
from fathomline.llm.packing import pack
from fathomline.llm.toxicity import fit_toxicity, held_out, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model is fitted on the labelled ones outside the held-out fifth.

    Each row is scored by itself, so repeated rows stay or go together. Null
    and empty texts have no token and stay.
    """
    labels = read(spark, sf_dir, "labels").filter(~held_out())
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).filter("score < 0.5").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest identifier, of each group of equal texts.

    Null and empty texts are one group; of rows repeated with one identifier
    one stays; rows without identifier come after all others.
    """
    return drop_exact_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles at a similarity of 0.8, that of the smallest identifier.

    Null, empty and blank texts and rows without identifier are linked with
    nothing and stay; repeats of a row that stays stay, too.
    """
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Repeated rows stay or go together; null, empty and short texts and rows
    without identifier stay.
    """
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left and their places in sequences of 1024 tokens.

    Null and empty texts are one piece, very long ones many; repeated rows and
    rows without identifier are packed like any other.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: Scoring, components and tokens can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.keep(docs)  # the stage before is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
