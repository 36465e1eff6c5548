"""Personal data: base patterns, and information-theoretic sanitisation; DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers: the protected
entities. Terms that share documents with an entity may reveal it just as well: words, and numbers
with what joins their digits, such as dates. How well is read off the corpus: with n(c) documents
that hold entity c, n(t) that hold term t, n(c, t) that hold both, at any distance, and N
documents, the term discloses log(N n(c, t) / (n(c) n(t))) of the entity's information log(N / n(c)).
That a term stands beside an entity once says nothing about either, and copies say it no better: a
pair counts from ``SUPPORT`` different texts on. Terms at or above ``GENERALISE`` of the
information are to be generalised and those at or above ``REMOVE`` removed, wherever they stand in
a document that holds the entity. All counts are over all documents.

Entities that stand in the same documents are equal in all of this, and so are terms; only their
classes are paired. A document with many entities and many words of its own has one class of
each, so its pairs do not grow with the square of its length.

Defined results: a null text is the empty text and has no spans; rows that repeat doc_id and text
are documents of their own with the same spans; an entity in every document carries no
information, so nothing discloses it; a term that two entities judge differently is removed; a
text of any length is read whole, its spans placed in runs of ``RUN``; an empty table gives no
rows; other columns, whatever their names, are ignored by ``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, carried, join_hot, shared_table, text_of, uncarried

#: The shares of an entity's information from which a term is generalised and removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Different texts that must hold both an entity and a term before the term can disclose it.
SUPPORT = 2

#: The base kinds in order. The guards before a first repetition let a search begin
#: only where a run begins or the last match ended: any later start meets the same failure, and
#: without them long runs would cost the square of their length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
WORD = r"\p{L}++|\p{N}++(?:[./:-]\p{N}++)*+"

SPAN = "struct<start:int,end:int,hit:string>"
#: Matches that are placed one after the other; runs of them are then placed as wholes.
RUN = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_runs(items: Column) -> Column:
    """The array cut into arrays of RUN."""

    def cut(items: Column) -> Column:
        runs = F.ceil(F.size(items) / F.lit(RUN)).cast("int")
        return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.slice(items, i * RUN + 1, F.lit(RUN)))).otherwise(F.filter(F.array(items), lambda _: F.lit(False)))

    return bound(items, cut)


def before_runs(runs: Column, after: Callable[[Column, Column], Column]) -> Column:
    """The number that each run begins with: 0, and after(the one before, its run) from then on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    return F.aggregate(runs, start, lambda acc, run: F.struct(after(acc["at"], run).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")), lambda acc: acc["begins"])


def spans(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """start, end and hit of the pattern's matches that keep lets pass, leftmost, not overlapping.

    What lies between matches and the matches themselves are taken apart by one pattern, so
    their lengths in code points add up to positions: within a run first, then run by run.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.when(keep(pair["hit"]), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def moved(run: Column, at: Column) -> Column:
        return F.transform(run["found"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["hit"].alias("hit")))

    runs = F.transform(in_runs(pairs), lambda run: F.aggregate(run, F.struct(F.lit(0).alias("at"), none.alias("found")), step))
    return bound(runs, lambda runs: F.flatten(F.zip_with(runs, before_runs(runs, lambda at, run: at + run["at"]), moved)))


def rewritten(text: Column, marked: Column, fill: str = "") -> Column:
    """text with each of the marked (start, end, by) replaced by its by; one that overlaps an earlier one only lengthens it, by fill a character."""

    def segment(run: Column, begin: Column) -> Column:
        end = F.greatest(begin, F.array_max(F.transform(run, lambda s: s["end"])))
        return F.struct(run.alias("run"), begin.alias("begin"), F.substring(text, begin + 1, end - begin).alias("text"))

    def replaced(part: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            free = F.substring(part["text"], acc["at"] - part["begin"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            by = F.when(s["start"] >= acc["at"], s["by"]).otherwise(F.repeat(F.lit(fill), F.greatest(s["end"] - acc["at"], F.lit(0))))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], free, by).alias("out"))

        return F.aggregate(part["run"], F.struct(part["begin"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def whole(runs: Column) -> Column:
        begins = before_runs(runs, lambda at, run: F.greatest(at, F.array_max(F.transform(run, lambda s: s["end"]))))
        last = F.coalesce(F.array_max(F.transform(F.flatten(runs), lambda s: s["end"])), F.lit(0))
        # every segment is cut out once, and its spans are placed within it
        return F.concat(F.array_join(F.transform(F.zip_with(runs, begins, segment), replaced), ""), F.substring(text, last + 1, F.length(text)))

    return bound(in_runs(F.array_sort(marked)), whole)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(back, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind. A text that lacks what its kind needs is not searched."""
    none = F.array().cast(f"array<{SPAN}>")

    def card(hit: Column) -> Column:
        n = F.length(digits(hit))
        return F.when((n >= 13) & (n <= 19), luhn(digits(hit))).otherwise(F.lit(False))

    def phone(hit: Column) -> Column:
        n = F.length(digits(hit))
        return (n >= 9) & (n <= 15)

    return {
        "email": F.when(text.contains("@"), spans(text, EMAIL, lambda h: F.lit(True))).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), spans(text, IP, lambda h: h.rlike(IP_PARTS))).otherwise(none),
        "card": F.when(text.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), spans(text, CARD, card)).otherwise(none),
        "phone": F.when(text.contains("+"), spans(text, PHONE, phone)).otherwise(none),
    }


def entities() -> Column:
    """Every protected entity with its place: kind and normalised value, start and end."""

    def of(kind: str, value: Callable[[Column], Column]) -> Column:
        return F.transform(kind, lambda s: F.struct(F.concat(F.lit(kind + ":"), value(s["hit"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(of("email", F.lower), of("ip", lambda h: h), of("card", digits), of("phone", digits))


def words_of(text: Column) -> Column:
    """The distinct terms in lower case; the same that WORD finds."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(F.array_distinct(words), lambda w: F.lower(w)))


def document_counts(docs: DataFrame) -> DataFrame:
    """term and n_term, the number of documents that hold it, over all terms of all documents."""
    return docs.select(F.explode(words_of(text_of())).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def class_key(*more: Column) -> Column:
    """One value for all that stand in the same rows: two 64-bit sums without carry of the rows, their number, and more."""
    rows = [F.bit_xor(F.xxhash64(F.lit(seed), "row_key", "copy")) for seed in ("a", "b")]
    return F.struct(F.count("*").alias("n"), *[r.alias(f"s{i}") for i, r in enumerate(rows)], *more)


def disclosing(held: DataFrame, texts: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """row_key, copy, term and action of the terms at or above the thresholds in the rows that hold an entity.

    held has one row per document and entity in it, texts the text of each such document.
    """
    per_entity = shared_table(held.groupBy("entity").agg(class_key().alias("e")).withColumn("n", F.col("e.n")), "pii-entities")
    n = F.lit(float(total))

    def most(n_entity: Column) -> Column:
        """No term in more documents reaches GENERALISE, as n_pair is n_entity at most; a little is added for rounding."""
        return F.pow(n, F.lit(1 - GENERALISE)) * F.pow(n_entity.cast("double"), F.lit(GENERALISE)) * 1.001

    facts = per_entity.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    counts = shared_table(document_counts(docs).where(F.col("n_term") >= SUPPORT), "pii-counts")
    spent = counts.agg(F.coalesce(F.sum("n_term"), F.lit(0)).alias("s")).first()["s"]
    rare = F.col("n_term") <= most(F.lit(facts["most"]))
    # the terms that make up most of all texts go before anything is shuffled: fewer than HOT_SHARE have so large a part
    common = counts.where(~rare & (F.col("n_term") > spent // HOT_SHARE)).select("term")
    words = texts.select("row_key", "copy", F.explode(words_of(F.col("text"))).alias("term")).join(F.broadcast(common), "term", "left_anti")
    words = shared_table(words.join(counts.where(rare), "term"), "pii-words")
    per_term = words.groupBy("term").agg(class_key(F.first("n_term").alias("n_term")).alias("t"))
    in_row = words.select("row_key", "copy", "term").join(per_term.where(F.col("t.n") >= SUPPORT), "term")
    in_row = shared_table(in_row, "pii-terms-of-rows")
    some = per_entity.where(F.col("n") >= SUPPORT)
    classes = join_hot(held, some, "entity", "n", facts["rows"]).select("row_key", "copy", "e").distinct()
    both = classes.join(in_row.select("row_key", "copy", "t").distinct(), ["row_key", "copy"]).where(F.col("t.n_term") <= most(F.col("e.n")))
    pairs = shared_table(both.join(texts.select("row_key", "copy", F.md5("text").alias("text_key")), ["row_key", "copy"]), "pii-pairs")
    scored = pairs.groupBy("e", "t").agg(F.count("*").alias("n_pair"), F.countDistinct("text_key").alias("n_texts")).where(F.col("n_texts") >= SUPPORT)
    shown = F.log2(F.col("n_pair") * n / (F.col("e.n") * F.col("t.n_term")))
    full = F.log2(n / F.col("e.n"))
    scored = scored.withColumn("disclosure", F.when(full > 0, shown / full))
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    found = shared_table(scored.where(F.col("disclosure") >= GENERALISE).select("e", "t", action.alias("action")), "pii-disclosing")
    # back from classes to terms; one that some entity wants removed is removed
    per_row = pairs.join(found, ["e", "t"]).groupBy("row_key", "copy", "t").agg(F.max("action").alias("action"))
    return per_row.join(in_row, ["row_key", "copy", "t"]).select("row_key", "copy", "term", "action")


def added_spans(texts: DataFrame, found: DataFrame) -> DataFrame:
    """row_key, copy and, for each action, the spans of the disclosing terms, in order.

    texts has the base spans as well: terms are looked for outside of them, and one that reaches into one ends there.
    """
    blanks = F.transform(F.concat(*BASE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - s["start"]).alias("by")))
    some = texts.join(found.select("row_key", "copy").distinct(), ["row_key", "copy"], "left_semi")
    places = some.select("row_key", "copy", F.explode(spans(rewritten(F.col("text"), blanks, " "), WORD, lambda _: F.lit(True))).alias("span"))
    marked = places.withColumn("term", F.lower("span.hit")).join(found, ["row_key", "copy", "term"])
    return marked.groupBy("row_key", "copy").agg(*[F.array_sort(F.collect_list(F.when(F.col("action") == a, F.col("span")))).alias(a) for a in ADDED])


def analysed(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base spans by kind, and the added spans of both actions, one row per row of docs."""
    text = text_of()
    rows = docs.select("doc_id", *extra, F.xxhash64("doc_id", text).alias("row_key"), F.monotonically_increasing_id().alias("copy"), text.alias("text"))
    rows = rows.select("*", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    some = sum((F.size(k) for k in BASE[1:]), F.size(BASE[0])) > 0
    # the text goes along only where an entity stands in it
    rows = shared_table(rows.withColumn("text", F.when(some, F.col("text"))), "pii-rows")
    texts = rows.where("text IS NOT NULL")
    held = texts.select("row_key", "copy", F.explode(F.transform(entities(), lambda e: e["entity"])).alias("entity"))
    found = shared_table(disclosing(shared_table(held.distinct(), "pii-held"), texts, docs, rows.count()), "pii-terms")
    rows = rows.join(shared_table(added_spans(texts, found), "pii-added"), ["row_key", "copy"], "left")
    none = F.array().cast(f"array<{SPAN}>")
    return rows.select("doc_id", *extra, *BASE, *[F.coalesce(a, none).alias(a) for a in ADDED])


def joined(kinds: tuple[str, ...]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return analysed(docs).select("doc_id", *counts, F.sha2(joined(BASE), 256).alias("base_sha256"), joined((*BASE, *ADDED)).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with each entity and each generalised term replaced by its kind, and removed terms gone."""
    rows = carried(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    kept = analysed(rows, ("row",)).withColumn("whole", text_of("row.text"))

    def places(kind: str) -> Column:
        by = F.lit("" if kind == "remove" else f"[{kind.upper()}]")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by.alias("by")))

    clean = rewritten(F.col("whole"), F.concat(*[places(k) for k in (*BASE, *ADDED)]))
    found = sum((F.size(k) for k in (*BASE[1:], *ADDED)), F.size(BASE[0])) > 0
    return uncarried(kept.withColumn("clean", F.when(found, clean).otherwise(F.col("row.text"))), docs, text=F.col("clean"))
