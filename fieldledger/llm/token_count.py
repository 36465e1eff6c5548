"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes the pieces of the tokenizer's own pre-tokenizer, a piece the letters that stand for
its bytes. Neighbours of a doubly linked list form pairs, a heap holds those that the vocabulary
can merge, and the pair of the lowest rank, the leftmost of equals, is popped and merged until none is
left. Every merge takes away one symbol, so a piece has as many tokens as bytes less merges; which
tokens they are is never looked up. A piece of n bytes takes n log n steps, however long it is.

A pre-tokenizer of this kind never looks past a single space before a visible character, so texts
are cut there, and each worker remembers the counts of chunks and pieces, up to a bound, for the
next time they come up. Texts with a space before other white space or at their end are cut into
pieces whole. Nothing is shuffled: every text is counted where it is read.

Defined results: a null or empty text has no bytes and no tokens; a very long text is counted
whole, in the memory of the text and of one piece's list; the string of a special token inside a
text is one token, as the library has it by default; repeated rows, equal texts and null ids are
counted row by row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: A document of more tokens is over the limit.
LIMIT = 512
#: Characters of the chunks and pieces that a worker remembers from former texts; only speed depends on it.
CACHE_CHARS = 4_000_000
#: The letter by which vocabularies of this kind write the byte of a space.
SPACE = "\u0120"
COUNTS = "doc_id long, n_bytes long, n_tokens long"

_COUNTERS: dict[str, "Counter"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def merged_length(symbols: str | list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair can be merged any more."""
    at = list(symbols)
    n = left = len(at)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((at[i], at[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # a symbol merged away is None, so pairs that no longer stand are known by their rank
        if j >= n or ranks.get((at[i], at[j])) != rank:
            continue
        at[i], at[j] = at[i] + at[j], None
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((at[i], at[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        h = before[i]
        if h >= 0 and (rank := ranks.get((at[h], at[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return left


class Recent:
    """Counts by string. When those learned last outgrow the bound, they become the former ones
    and what is asked for again is taken over, so that common strings stay."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.former: dict[str, int] = {}
        self.chars = 0

    def learn(self, wanted: set[str], count) -> dict[str, int]:
        """A mapping that holds all of wanted; count gives the counts of a list of unknown ones."""
        if self.chars > CACHE_CHARS:
            self.known, self.former, self.chars = {}, self.known, 0
        if missing := wanted.difference(self.known):
            found = {c: self.former[c] for c in missing if c in self.former}
            fresh = [c for c in missing if c not in found]
            self.known.update(found)
            self.known.update(zip(fresh, count(fresh), strict=True))
            self.chars += sum(map(len, missing))
        return self.known


class Counter:
    """Counts the tokens that a byte-level BPE tokenizer file (.json) gives a text.

    Files of another kind (normalizers, word ends, byte fallback, dropout, special tokens that take
    the blanks beside them) are refused rather than counted wrongly.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        model, added = known["model"], known.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer",) if known.get(k)] + [k for t in added for k in ("lstrip", "rstrip", "single_word") if t.get(k)]
        if odd or model.get("type") != "BPE" or (known.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or known["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer {odd or ''}")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole = re.compile(r" \s| \Z")
        self.chunks, self.merged = Recent(), Recent()

    def merge(self, pieces: list[str]) -> list[int]:
        return [merged_length(p, self.ranks) for p in pieces]

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """The pieces of a text, in the alphabet of the vocabulary, with their counts."""
        found = [piece for piece, _ in self.split(text)]
        known = self.merged.learn(set(found), self.merge)
        return [(piece, known[piece]) for piece in found]

    def spaced(self, chunks: list[str]) -> list[int]:
        """The counts of chunks that begin with their only space: in one text, it begins each anew."""
        out: list[int] = []
        for piece, n in self.pieces("".join(chunks)):
            if piece[0] == SPACE:
                out.append(n)
            else:
                out[-1] += n
        return out

    def plain(self, text: str) -> int:
        """The count of a text without special tokens."""
        if not text:
            return 0
        if self.whole.search(text):
            return sum(n for _, n in self.pieces(text))
        first, *rest = text.split(" ")
        chunks = [" " + c for c in rest]
        known = self.chunks.learn(set(chunks), self.spaced) if chunks else {}
        return sum(n for _, n in self.pieces(first)) + sum(map(known.__getitem__, chunks))

    def __call__(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.special.split(text)))


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            tokens = [count(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``), one row per row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    return texts.mapInArrow(_counted(tokenizer or default_tokenizer()), COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
