"""Toxicity scores from a learned lexicon, misspellings included.

All labelled documents that are not held out yield the lexicon: whole words, and word beginnings
for languages that compound, that stand in toxic documents far more often than in others. Its trie
is intersected with Levenshtein automata: a state is the set of (trie node, edits so far) that
a word's letters can have reached, made deterministic step by step as words call for it, so
every word is read once against all terms and all their misspellings together; a beginning that
has been reached within its edits stays found, whatever follows it.

Each hit is then read in its context, a window of words on either side. What the words of the
window say for or against abuse is learned from the windows of half of these documents, and whether the hit
stands between quotation marks is told by following the marks through the whole text. Counts
of hits by kind, crowding and context go into a logistic regression, which is fitted on the other
half and gives the score. Counts, moments and the sums of each step of the fit are added up in
tasks; what the driver sees are the terms and words that are common enough, and these sums.

Defined results: a null text is the empty text and is scored as one without hits; a document
whose label is null, missing or out of 0 and 1 is only scored; labels given twice count as toxic
if any says so, and the smallest text counts of those that share a labelled doc_id; without labels of both kinds every score is 0; terms that are equally near tie to
the longer and then the first one; repeated rows are scored each; a text of any length is read
whole, in memory that grows with its words; an empty table gives no rows; other columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import carried, discard, shared_table, small_batches, text_of

#: The least ratio of shares, the least root of the likelihood ratio statistic, and the least share of toxic documents, of a term.
LIFT, LEAST_Z, LEAST_SHARE = 4.0, 4.5, 0.004
#: Lengths of word beginnings that may become terms; a longer beginning begins with one of these.
STEMS = range(4, 11)
#: Words on either side that a window takes in; documents in which a word must stand near hits to say anything of them, and
#: the least share of those with hits, so that the words that do are as many for any number of documents.
WINDOW, LEAST_NEAR, NEAR_SHARE = 12, 20, 0.002
#: Terms that a task counts before it passes them on.
COUNTED = 100_000
#: What a worker remembers of words and of automaton steps; only speed depends on it.
CACHE, STEPS = 300_000, 100_000

WORD = re.compile(r"\w+")
#: Quotation marks that open, with those that close them, and lines that quote.
CLOSING = {'"': '"', "“": "”", "«": "»", "„": "“”", "‚": "‘’", "‹": "›"}
MARKS = re.compile('["“”«»„‚‘’‹›]|^>.*$', re.MULTILINE)
FEATURES = 11


def quotations(text: str) -> list[tuple[int, int]]:
    """Where the text quotes, whatever the length: between a mark and the next one that closes it, and lines after >.

    A straight mark opens only after a blank, a bracket or the start, and closes only after something else, so one
    that stands for inches or was left over quotes nothing. A mark that is opened again before it
    is closed begins anew; one that is never closed quotes nothing. A quotation may run over paragraphs.
    """
    spans, mark, begin = [], "", 0
    for m in MARKS.finditer(text):
        c = m[0]
        if c[0] == ">":
            if not mark:
                spans.append(m.span())
        else:
            free = m.start() == 0 or text[m.start() - 1].isspace() or text[m.start() - 1] in "([{<"
            if mark and c in CLOSING[mark] and not (c == '"' and free):
                spans.append((begin, m.end()))
                mark = ""
            elif c in CLOSING and (not mark or c == mark) and (c != '"' or free):
                mark, begin = c, m.start()
    return spans


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        """Edits that still count as this term; beginnings, which leave more open, need to be a letter longer."""
        n = len(self.text) - self.stem
        return 0 if n < 5 else 1 if n < 9 else 2


class Matcher:
    """The trie of terms intersected with Levenshtein automata, made deterministic on demand."""

    def __init__(self, terms: tuple[Term, ...]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # edits that any term below still allows
        for t, term in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], term.edits)
            self.ends[node].append(t)
        self.clear()

    def clear(self) -> None:
        self.known: set[str] = set()  # words that have been read
        self.near: dict[str, tuple[int, int]] = {}  # those that are terms or misspell them
        self.forget()

    def forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[tuple[frozenset, frozenset]] = []
        self.step: list[dict[str, int]] = []
        self.steps = 0
        self.result: list[tuple[int, int] | None] = []
        self.start, self.lost = self.state({(0, 0)}, frozenset()), self.state(set(), frozenset())

    def state(self, reached: set[tuple[int, int]], begun: frozenset) -> int:
        """The number of the state; begun holds (beginning, edits) of those that have been read in full."""
        todo = list(reached)
        least: dict[int, int] = {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or e >= least.get(node, 99):
                continue
            least[node] = e
            todo += [(n, e + 1) for n in self.children[node].values()]  # a letter of the term is missing
        ends = [(t, e) for n, e in least.items() for t in self.ends[n] if e <= self.terms[t].edits]
        read = dict(begun)
        for t, e in ends:
            if self.terms[t].stem:
                read[t] = min(e, read.get(t, e))
        key = (frozenset(least.items()), frozenset(read.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            found = [(e, -len(self.terms[t].text), t) for t, e in [*ends, *read.items()]]
            best = min(found, default=None)
            self.result.append(best and (best[2], best[0]))
        return self.states[key]

    def __call__(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        return self.among({word}).get(word)

    def among(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """(term, edits) of the nearest term for each of the words that has one."""
        if len(self.known) > CACHE:
            self.known, self.near = set(), {}
        for word in words - self.known:
            if (hit := self.read(word)) is not None:
                self.near[word] = hit
        self.known |= words
        return {w: self.near[w] for w in words & self.near.keys()}

    def read(self, word: str) -> tuple[int, int] | None:
        if self.steps > STEPS:
            self.forget()
        at, step, sets = self.start, self.step, self.sets
        for c in word:
            to = step[at].get(c)
            if to is None:
                reached, begun = sets[at]
                after: set[tuple[int, int]] = set()
                for node, e in reached:
                    if c in self.children[node]:
                        after.add((self.children[node][c], e))
                    after.add((node, e + 1))  # a letter too many
                    after |= {(n, e + 1) for k, n in self.children[node].items() if k != c}  # another letter
                to = step[at][c] = self.state(after, begun)
                self.steps += 1
            at = to
            if at == self.lost:
                break
        return self.result[at]


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...] = ()
    context: dict = field(default_factory=dict)
    mean: tuple[float, ...] = (0.0,) * FEATURES
    scale: tuple[float, ...] = (1.0,) * FEATURES
    weights: tuple[float, ...] = (0.0,) * FEATURES
    bias: float = -math.inf
    made: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(word number, term, edits) of the words that are terms or misspell them."""
        matcher = self.made.get("matcher") or self.made.setdefault("matcher", Matcher(self.terms))
        found = matcher.among(set(words))
        return [(i, *found[w]) for i, w in enumerate(words) if w in found] if found else []

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        hits = self.hits(words)
        if not hits:
            return [0.0] * (FEATURES - 1) + [math.log1p(len(words))]
        quoted: set[int] = set()
        if spans := quotations(low):
            begins = [m.start() for m in WORD.finditer(low)]
            at = 0
            for i, _, _ in hits:
                while at < len(spans) and spans[at][1] <= begins[i]:
                    at += 1
                if at < len(spans) and spans[at][0] <= begins[i]:
                    quoted.add(i)
        abuse = [x for x in hits if x[0] not in quoted]
        exact = [(i, t) for i, t, e in abuse if e == 0]
        misspelt = sum(e > 0 and not self.terms[t].stem for _, t, e in abuse)
        weight = sum(self.terms[t].weight for _, t in exact)
        crowd, lo = 0, 0
        for k, (i, _) in enumerate(exact):
            while exact[lo][0] < i - 2 * WINDOW:
                lo += 1
            crowd = max(crowd, k - lo + 1)
        # what the windows say, for and against abuse; a word between two hits speaks to both
        said = np.r_[0.0, np.cumsum([self.context.get(w, 0.0) for w in words])] if self.context and exact else np.zeros(len(words) + 1)
        windows = [said[min(i + WINDOW + 1, len(words))] - said[max(i - WINDOW, 0)] for i, _ in exact]
        return [
            math.log1p(len(exact)), math.log1p(misspelt), math.log1p(len(abuse) - len(exact) - misspelt), math.log1p(len(quoted)), math.log1p(len({t for _, t in exact})),
            math.log1p(weight), math.log1p(100.0 * len(exact) / (len(words) + 20)), math.log1p(crowd),
            math.log1p(sum(w for w in windows if w > 0)), math.log1p(sum(-w for w in windows if w < 0)), math.log1p(len(words)),
        ]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.bias == -math.inf:
            return np.zeros(len(features))
        z = (features - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def held_out() -> Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and half (0 or 1) of every labelled document that is not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    texts = docs.select("doc_id", text_of().alias("text")).where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("text").alias("text"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    # always a shuffled join: a broadcast would turn into one as the labels grow
    return shared_table(texts.join(known.hint("merge"), "doc_id").select("text", "toxic", half), "toxicity-texts")


def _counts(found: Callable[[str], set[str]]):
    """In how many documents of either label a term is found; a task may tell of a term more than once."""

    def told(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([counts[k][t] for t in terms], pa.int64()) for k in (0, 1)]], ["term", "clean", "toxic"])
        for c in counts:
            c.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True):
                    counts[toxic].update(found(text))
                    if len(counts[0]) + len(counts[1]) > COUNTED:
                        yield told(counts)
        yield told(counts)

    return run


def counted(texts: DataFrame, found: Callable[[str], set[str]]) -> DataFrame:
    """term, clean and toxic: in how many documents of either label each term is found."""
    told = texts.select("text", "toxic").mapInArrow(_counts(found), "term string, clean long, toxic long")
    return told.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _terms(wanted: frozenset[str] | None = None) -> Callable[[str], set[str]]:
    """The words of a text and, ending in *, their beginnings; if some are wanted, these alone."""
    heads = {t[: STEMS[0]] for t in wanted or () if t[-1] == "*"}

    def found(text: str) -> set[str]:
        words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
        begun = {w[:n] + "*" for w in words if wanted is None or w[: STEMS[0]] in heads for n in STEMS if len(w) > n}
        return words | begun if wanted is None else (words & wanted) | (begun & wanted)

    return found


def choose_terms(rows: list[tuple[str, int, int]], n_clean: int, n_toxic: int) -> tuple[Term, ...]:
    """rows: (term, clean documents, toxic documents); a term ending in * is a beginning."""

    def weigh(clean: int, toxic: int) -> tuple[float, float]:
        """Log odds ratio, and the root of the likelihood ratio statistic."""
        odds = math.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - math.log((clean + 0.5) / (n_clean - clean + 0.5))
        share, n = (toxic + clean) / (n_toxic + n_clean), 0.0
        for seen, of in ((toxic, n_toxic), (clean, n_clean)):
            for got, expected in ((seen, of * share), (of - seen, of * (1 - share))):
                n += got * math.log(got / expected) if got else 0.0
        return odds, math.sqrt(max(0.0, 2 * n))

    ranked = sorted(((*weigh(c, t), term, t) for term, c, t in rows), key=lambda x: (-x[1], x[2]))
    ranked = [x for x in ranked if x[1] >= LEAST_Z]
    counts = {term: t for _, _, term, t in ranked}
    # a beginning gives way to a longer one, or to a whole word, that is nearly as frequent
    weak = {s + "*" for term, t in counts.items() for w in [term.rstrip("*")] for n in range(1, len(w) + (term[-1] != "*")) if (s := w[:n]) + "*" in counts and t >= 0.85 * counts[s + "*"]}
    chosen: list[Term] = []
    stems: list[str] = []
    for odds, _, term, _ in ranked:
        text = term.rstrip("*")
        if term not in weak and not any(text.startswith(s) for s in stems):
            chosen.append(Term(text, term[-1] == "*", odds))
            stems += [text] * (term[-1] == "*")
    return tuple(chosen)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _step_sums(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """A task's part of the Hessian and of the gradient of the likelihood at w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FEATURES + 2, FEATURES + 1))
        for batch in batches:
            a = np.hstack([(_matrix(batch["f"]) - mean) / scale, np.ones((batch.num_rows, 1))])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            sums += np.vstack([(a * (p * (1 - p))[:, None]).T @ a, a.T @ (batch["toxic"].to_numpy() - p)])
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], ["sums"])

    return run


def fit_weights(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression of toxic on f by Newton's method: a step is one pass over rows, of which the driver sees one sum a task."""
    w = np.zeros(FEATURES + 1)
    penalty = np.diag([ridge] * FEATURES + [1e-6])
    for _ in range(rounds):
        told = rows.mapInArrow(_step_sums(mean, scale, w), "sums array<double>").collect()
        sums = np.sum([r["sums"] for r in told], axis=0).reshape(FEATURES + 2, FEATURES + 1)
        step = np.linalg.solve(sums[:-1] + penalty, sums[-1] - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = np.round(w, 9)  # the order in which tasks' sums are added has no say
    return w[:-1], float(w[-1])


def _near_words(model: Model) -> Callable[[str], set[str]]:
    """The words near hits, and "" if there are hits at all."""

    def found(text: str) -> set[str]:
        words = WORD.findall(text.lower())
        taken = {i for i, _, _ in model.hits(words)}
        near = {j for i in taken for j in range(max(i - WINDOW, 0), min(i + WINDOW + 1, len(words)))}
        return {words[j] for j in near - taken} | ({""} if taken else set())

    return found


def choose_context(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """The log odds of abuse that a word near a hit stands for; rows: (word, clean documents, toxic documents), "" for all."""
    counts = {term: (c, t) for term, c, t in rows}
    clean, toxic = counts.pop("", (0, 0))
    if not clean or not toxic:
        return {}
    # the added documents pull rare words towards saying nothing
    added = LEAST_NEAR / 4
    share = toxic / (clean + toxic)
    odds = {w: math.log((t + added * share) / toxic) - math.log((c + added * (1 - share)) / clean) for w, (c, t) in counts.items()}
    return {w: x for w, x in odds.items() if abs(x) > 0.5}


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                f = [model.features(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), part["toxic"]], ["f", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    texts = training_texts(docs, labels)
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Model()
    # a document has so many terms, and each that passes takes its share of the toxic ones: as many for any number of documents
    often = F.col("toxic") >= max(3.0, LEAST_SHARE * toxic)
    seen = {r["term"]: r["toxic"] for r in counted(texts.where("toxic = 1"), _terms()).where(often).collect()}
    also = {r["term"]: r["clean"] for r in counted(texts.where("toxic = 0"), _terms(frozenset(seen))).collect()}
    lifted = [(term, also.get(term, 0), t) for term, t in seen.items() if t * clean >= also.get(term, 0) * LIFT * toxic]
    model = Model(choose_terms(lifted, clean, toxic))
    # contexts are learned from one half and weighed on the other, so that no document vouches for itself
    near = shared_table(counted(texts.where("half = 0"), _near_words(model)), "toxicity-near")
    hit = near.where("term = ''").select(F.col("clean") + F.col("toxic")).head()
    common = (F.col("term") == "") | (F.col("clean") + F.col("toxic") >= max(LEAST_NEAR, NEAR_SHARE * (hit[0] if hit else 0)))
    model = Model(model.terms, choose_context([tuple(r) for r in near.where(common).collect()]))
    other = texts.where("half = 1")
    if other.select("toxic").distinct().count() < 2:  # too few labels to set half of them aside
        other = texts
    rows = shared_table(other.select("text", "toxic").mapInArrow(_features(model), "f array<double>, toxic int"), "toxicity-features")
    f = [F.col("f")[i] for i in range(FEATURES)]
    found = np.array(rows.agg(*map(F.avg, f), *map(F.stddev_pop, f)).head(), float)
    mean, scale = np.round(found[:FEATURES], 9), np.maximum(np.round(found[FEATURES:], 9), 1e-6)
    weights, bias = fit_weights(rows, mean, scale)
    discard(texts, near, rows)
    return Model(model.terms, model.context, tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist()), bias)


def _score(model: Model):
    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [texts.iloc[at : at + 1000] for at in range(0, len(texts), 1000)]
            scores = [model.score(np.array([model.features(t) for t in part]).reshape(-1, FEATURES)) for part in parts]
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    return run


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs in one struct, as they are), score and predicted. Only the texts go to Python, in small batches."""
    small_batches(docs.sparkSession)
    scored = carried(docs).withColumn("score", _score(model)(text_of("row.text")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not call toxic, all columns as they are."""
    return apply(docs, model).where("predicted = 0").select("row.*")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from a model fitted on labels."""
    lean = docs.select("doc_id", "text")
    return apply(lean.withColumn("held_out", held_out()), fit(lean, labels)).select("row.doc_id", "row.held_out", "score", "predicted")
