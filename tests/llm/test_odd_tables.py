"""Columns whose names operators might use themselves, and odd and empty tables, through every operator that keeps its input's columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathomline.llm.decontamination import drop_contaminated
from fathomline.llm.exact_dedup import drop_exact_copies, lsm_dedup
from fathomline.llm.ngram_join import drop_similar, similar_components
from fathomline.llm.packing import pack
from fathomline.llm.quality import fit_forest, score_quality
from fathomline.llm.sharding import label_propagation_shards
from fathomline.llm.suffix_dedup import remove_repeats
from fathomline.llm.token_counts import count_tokens
from fathomline.llm.toxicity import Scorer, score_toxicity, spans, train
from fathomline.llm.url_filter import judge_urls

NAMES = "_p _block _bits _place _id _key _h _g _digest _hit _maybe _dropped _owner _tags _j _judged _text _y id body n rep bucket at component a b token run digest low high salt hash first last seed item host path rule verdict x".split()


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("doc_id", "text", *[F.lit(f"of {n}").alias(n) for n in NAMES])


def unchanged(df):
    return all(r[n] == f"of {n}" for r in df.collect() for n in NAMES if n in df.columns)


def test_columns_pass(spark, clashing, odd):
    tests = spark.createDataFrame([(1, " ".join(f"word{i % 977}x{i % 13}" for i in range(20, 60)))], "item_id long, text string")
    model = train(["foul zorgum here", "fair words here"], np.array([1.0, 0.0]))
    for drop in (drop_exact_copies, drop_similar, lambda d: drop_contaminated(d, tests)):
        got = drop(clashing)
        assert got.columns == clashing.columns and unchanged(got)
        assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((r.doc_id or 0, r.text or "") for r in drop(odd).collect())
    assert drop_contaminated(clashing, tests).count() == 10
    scored = score_toxicity(clashing, model)
    assert scored.columns == [*clashing.columns, "score", "toxic_spans"] and unchanged(scored)
    judged = judge_urls(clashing.withColumnRenamed("text", "url"), [("block", "org")])
    assert {r["_j"] for r in judged.collect()} == {"of _j"} and {r.verdict for r in judged.collect()} == {"allow"}


def test_results_do_not_depend_on_further_columns(clashing, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for operator in (lsm_dedup, similar_components, label_propagation_shards, lambda d: remove_repeats(d, length=100), lambda d: pack(d, path)):
        assert sorted(map(repr, operator(clashing).collect())) == sorted(map(repr, operator(odd).collect()))
    counted = count_tokens(clashing, path)
    assert unchanged(counted) and counted.count() == 12


def test_quality_of_clashing(clashing):
    forest = fit_forest(np.zeros((0, 1)), np.zeros(0))
    assert unchanged(score_quality(clashing, forest)) and {r.score for r in score_quality(clashing, forest).collect()} == {0.5}


def test_spans_are_those_of_the_text():
    """Letters that grow in lower case don't shift what follows."""
    model = train(["x zorgum"] * 8 + ["x fair"] * 8, np.array([1.0] * 8 + [0.0] * 8))
    text = "\u0130\u0130\u0130 x ZORGUM fair"
    p = Scorer(model).token_marginals([text])[0]
    p[:] = 0
    p[-2] = 1
    assert [text[s["start"] : s["end"]] for s in spans(text, p)] == ["ZORGUM"]
