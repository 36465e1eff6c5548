"""The forest's prefixes depend on the threshold alone, not on what a table mostly holds."""

from fieldledger.llm import near_dup


def depths(spark, monkeypatch, texts):
    taken, plain = [], near_dup.likely_components

    def noted(*args):
        comps, took = plain(*args)
        taken.extend(took)
        return comps, took

    monkeypatch.setattr(near_dup, "likely_components", noted)
    rows = near_dup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    monkeypatch.undo()
    return taken, {r["doc_id"]: r["class_id"] for r in rows}


def test_close_pairs_do_not_stop_the_forest(spark, monkeypatch):
    """Where all pairs that are met are nearly equal, pairs at the threshold still have the recall asked for."""
    texts = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(300)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    taken, classes = depths(spark, monkeypatch, texts)
    assert [d for d, _ in taken] == [8, 4] and taken[-1][1] >= near_dup.RECALL
    assert all(classes[i] == i - i % 2 for i in range(80))
    # a table without any pair takes the same ones
    assert depths(spark, monkeypatch, texts[::2])[0] == taken
