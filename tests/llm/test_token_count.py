"""Token counts against the library, and heap merging against plain rescanning."""

import random
from collections import Counter

import pytest
from fieldledger.llm import token_count
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "\n \n\t", "it's we'll I'd 'tis don''t", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext|", "a" * 3000, " " * 999, "ab " * 400,
    "漢字 テスト、😀 é é　wide space", "1234567890 12,345.67", "tail of spaces   \nand more \n\n  x", "\x85next\x1cfs", "Étion dans, çouelle\nun éonierç .", "{\"k\": [1, 2]}\r\n\tend",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_count.default_tokenizer())


def rescanned(symbols, ranks):
    """The same merging, looking through all pairs each time."""
    at = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(at, at[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return len(at)
        i = best[1]
        at[i : i + 2] = [at[i] + at[i + 1]]


def test_heap_merging_equals_rescanning():
    rng = random.Random(3)
    for _ in range(300):
        pairs = {}
        for _ in range(rng.randint(0, 12)):
            parts = ["a", "b", "c", *[x + y for x, y in pairs]]
            pairs.setdefault((rng.choice(parts), rng.choice(parts)), len(pairs))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert token_count.merged_length(text, pairs) == rescanned(text, pairs)


def test_counts_equal_the_library(library):
    count = token_count.counter(token_count.default_tokenizer())
    rng = random.Random(7)
    letters = [*"abcdefghij etaoin ETA\n\t .,'0123éß漢", "<|endoftext|>", "  ", " the", "‍", "\U0001f600"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    assert [count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_forgetting_changes_no_count(library, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_CHARS", 40)
    count = token_count.Counter(token_count.default_tokenizer())
    texts = [f"word{i % 7} other{i % 11} again, again{i}" for i in range(80)]
    assert [count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sum(map(len, count.chunks.known)) < 200


def test_other_kinds_of_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="no plain byte-level"):
        token_count.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark, library):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(0, None, 5), (None, "no id", None), (3, "a", 5), (99, "word " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("n_bytes", F.lit("x"))
    found = Counter(map(tuple, token_count.count_tokens(docs.repartition(3), limit=7).collect()))
    wanted = Counter()
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted[(i, len((t or "").encode()), n, n > 7)] += 1
    assert found == wanted
    assert token_count.count_tokens(docs.limit(0)).count() == 0
