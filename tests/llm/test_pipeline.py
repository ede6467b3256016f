"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_llm import brute_components, check_packing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tests = [r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns
        was, now = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert now.items() <= was.items()
        if name == "exact_dedup":
            assert Counter(now.values()) == Counter(set(was.values()))
        if name == "ngram_join":
            assert set(now) == {c for _, c in brute_components(was, 5, 80).values()}
        if name == "decontamination":
            has = lambda t, item: any(sum(t[i + j] == item[j] for j in range(n)) >= 0.8 * n for n in [min(24, len(item))] for i in range(len(t) - n + 1))
            whole = {d for d, t in was.items() if any(has(t.lower().split(), item) for item in tests)}
            assert whole <= set(was) - set(now) and len(now) > 0.9 * len(was)
        before = after
    check_packing(corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect(), {r.doc_id: r.text for r in before.collect()})
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
