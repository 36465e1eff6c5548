"""The pipeline's near-duplicate stage takes its prefixes from the threshold, whatever its table mostly holds."""

import corpus_pipeline
from fieldledger.llm import near_dup


def test_the_stage_takes_no_sample(spark, monkeypatch):
    taken, plain = [], near_dup.likely_components

    def noted(*args):
        comps, took = plain(*args)
        taken.extend(d for d, _ in took)
        return comps, took

    monkeypatch.setattr(near_dup, "likely_components", noted)
    texts = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(300)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == list(range(0, 80, 2))
    assert taken == [8, 4]
