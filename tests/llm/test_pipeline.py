"""The pipeline's stages, each on its own input, against what the stage must do."""

from collections import Counter

import corpus_pipeline
import pytest
from fieldledger.llm import line_dedup, mixing, near_dup, packing, toxicity

from tests.conftest import DATA


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The result of each stage, written and read again as the next one's input."""
    out, docs = [spark.read.parquet(f"{DATA}/documents.parquet")], spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(steps):
    for before in steps[:-1]:
        assert before.dtypes == steps[0].dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "source_mixing", "packing"]


def test_toxic_documents_go(spark, steps):
    model = toxicity.fit(steps[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    wanted = {r["row"]["doc_id"] for r in toxicity.apply(steps[0], model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in steps[1].collect()} == wanted


def test_repeated_lines_go(steps):
    own = {}
    rows = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    for doc, text in rows.items():
        for line in text.split("\n"):
            own[line_dedup.line_key(line)] = min(own.get(line_dedup.line_key(line), doc), doc)
    wanted = {d: "\n".join(x for x in t.split("\n") if len(line_dedup.line_key(x)) < 10 or own[line_dedup.line_key(x)] == d) for d, t in rows.items()}
    found = steps[2].collect()
    assert {r["doc_id"]: r["text"] for r in found} == wanted and all(r["n_chars"] == len(r["text"]) for r in found)


def test_one_of_each_group_stays(steps):
    rows = sorted((r["doc_id"], set(near_dup.shingles(r["text"]).tolist())) for r in steps[2].collect())
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if s and len(s & t) * 10 >= 8 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in steps[3].collect()) == [d for d, _ in rows if find(d) == d]


def test_the_mix_takes_what_it_says(steps):
    times = {r["doc_id"]: r["times"] for r in mixing.mix(steps[3]).collect()}
    assert Counter(r["doc_id"] for r in steps[4].collect()) == Counter({d: n for d, n in times.items() if n})


def test_everything_is_packed(steps):
    lengths = Counter()
    code = packing.coder(packing.default_tokenizer())
    for r in steps[4].collect():
        lengths[r["doc_id"]] += len(code([r["text"]])[0]) // 4 + 1
    packed = steps[5].toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == dict(lengths)
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packed.sequence_id.nunique() <= 1.1 * packed.length.sum() / 1024 + 1
