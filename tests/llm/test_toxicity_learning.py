"""The toxicity model learns from every labelled document that is not held out."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldledger.llm import toxicity


def test_no_labelled_document_is_left_out(spark):
    """An insult that stands only in documents beyond the first 8,000, by a hash of their ids, is learned."""
    ids = spark.range(14_000).withColumnRenamed("id", "doc_id").where(~toxicity.held_out())
    ids = [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert len(ids) > 10_000
    rng = random.Random(3)
    rows = []
    for at, i in enumerate(ids):
        bad = i % 6 == 0
        words = rng.choices([f"word{n}" for n in range(40)], k=8) + ["clown" if at < 8000 else "moron"] * bad
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert {t.text for t in model.terms} == {"clown", "moron"}
    scores = model.score(np.array([model.features(t) for _, t, _ in rows]))
    assert [int(s >= 0.5) for s in scores] == [bad for _, _, bad in rows]


def test_counts_are_whole(spark, monkeypatch):
    """Counts that a task passes on many times add up, and wanted terms have the counts that they have among all."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices([f"wörter{n}e" for n in range(60)] + ["ab", "abcde"], k=12)), rng.randrange(2)) for _ in range(300)]
    texts = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    wanted: dict[str, list[int]] = {}
    for text, toxic in rows:
        for term in {t for w in text.split() if len(w) > 2 for t in [w, *[w[:n] + "*" for n in range(4, 11) if len(w) > n]]}:
            wanted.setdefault(term, [0, 0])[toxic] += 1
    monkeypatch.setattr(toxicity, "COUNTED", 20)
    found = {r["term"]: [r["clean"], r["toxic"]] for r in toxicity.counted(texts, toxicity._terms()).collect()}
    assert found == wanted
    some = frozenset(sorted(wanted)[::3])
    found = {r["term"]: [r["clean"], r["toxic"]] for r in toxicity.counted(texts, toxicity._terms(some)).collect()}
    assert found == {t: wanted[t] for t in some}


def test_weights_equal_those_of_one_table(spark):
    """Newton's steps from tasks' sums against the same steps over all rows at once."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(700, toxicity.FEATURES))
    y = (x[:, 0] - 0.5 * x[:, 3] + draw.normal(size=700) > 0.4).astype(int)
    rows = spark.createDataFrame([(f.tolist(), int(t)) for f, t in zip(x, y, strict=True)], "f array<double>, toxic int").repartition(7)
    mean, scale = x.mean(0), x.std(0)
    weights, bias = toxicity.fit_weights(rows, mean, scale)
    a = np.hstack([(x - mean) / scale, np.ones((700, 1))])
    w, penalty = np.zeros(toxicity.FEATURES + 1), np.diag([1.0] * toxicity.FEATURES + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
    assert np.allclose([*weights, bias], w, atol=1e-8)


def test_a_shared_id_and_odd_labels(spark):
    """Rows of one id are one document, that of the smallest text; ids without a label, and null ones, are not learned from."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (4, 2)], "doc_id long, toxic int")
    held = {r[0] for r in docs.where(toxicity.held_out()).select("doc_id").collect()}
    found = sorted((r["text"], r["toxic"]) for r in toxicity.training_texts(docs, labels).collect())
    assert found == sorted(x for i, x in ((1, ("a", 1)), (2, ("", 0))) if i not in held)
