"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents become sets of five-word shingles. Equal sets are one class from the start, so copies
cost one row. Each class enters ``TREES`` prefix tries of MinHash values: its paths (tree number
and ``DEEPEST`` values) are range-sorted, so that the classes under any trie node stand side by
side and every prefix length is a streaming pass over the same sorted table.

The join begins with the full paths. Classes under one trie node are candidates, which their whole
signatures confirm or refuse. The prefixes are then shortened to the longest whose chance to find
a pair at the threshold itself reaches the target, for those trie nodes whose classes are not all
joined yet. A closer pair has a better chance, so this holds for every table: no length comes from
a sample or from the data. What is joined then is compared exactly, set by set.

Groups are dealt to blocks. A block is compared inside itself first; pairs of blocks follow only
where a group has several, and return, for each of its classes, how many documents it is linked to
and one edge for each pair of parts that were already connected inside their blocks. No step emits
the pairs of a group.

Words are runs of characters other than ASCII white space, in lower case. A text with fewer than
five words has one shingle, all its words. Shingles are compared as 64-bit hashes, sets of them
as 128-bit ones.

Defined results: a text without words, null included, links to nothing and is its own class;
rows with a null doc_id take part and have the class of what they equal, with a null class_id
only if no member has an id; repeated rows link to each other; ties do not arise, since links are
symmetric and a class is named by its smallest doc_id; a very long text is one set, held by one
task in 8 bytes a shingle; an empty table gives no rows; other columns, whatever their names, are
ignored by the join and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, discard, join_hot, shared_table, text_of

WORDS, THRESHOLD = 5, 0.8
#: The forest: trees, values of a full path, and the chance for a pair at the threshold at which shortening stops.
TREES, DEEPEST, RECALL = 20, 8, 0.9999
#: Signatures further below the threshold than so many standard errors are not compared exactly;
#: a pair at the threshold falls there with a chance of 1.4e-6 (binomial, 160 values).
SLACK = 5.0
#: Classes that are sampled to choose a prefix: none.
SAMPLE = 0
#: Classes and bytes of a block.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Paths of a range of the sorted tries.
RANGE_PATHS = 200_000
CACHE = 100_000
SEED = 11

#: Odd multipliers that mix 64-bit hashes.
MIX_A, MIX_B, FOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: What tasks return: an edge (node, root), and a node's links.
FOUND = "grp long, node binary, links long, root binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of the text's runs of so many words."""
    found = text.lower().encode("utf-8", "surrogatepass").split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    run = min(words, len(h))
    n = len(h) - run + 1
    total = np.full(n, run, np.uint64)
    for i in range(run):
        total = (total ^ (total >> np.uint64(29))) * FOLD + h[i : i + n]
    total = (total ^ (total >> np.uint64(33))) * MIX_A
    total = (total ^ (total >> np.uint64(33))) * MIX_B
    return np.unique(total ^ (total >> np.uint64(33)))


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(1, 1 << 63, count, np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, count, np.uint64)


def minima(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        x = s[at : at + 1024, None] * a
        x += b
        x ^= x >> np.uint64(32)
        np.minimum(best, x.min(axis=0), out=best)
    return best


def signature(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Sixteen bits of each minimum, big-endian, so that bytes sort like values."""
    return ((minima(s, family) * FOLD) >> np.uint64(48)).astype(">u2").tobytes()


def _signed(values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family(values)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys, signs = [], []
                for text in part["text"].to_pylist():
                    s = shingles(text)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signs.append(signature(s, family) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row_key"], pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "row_key", "node", "signature"])

    return run


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _runs(depth: int):
    """Streams sorted paths; yields the members of each trie node at that depth with company, and
    those of the first and last one of each range, whose company may stand in another range."""
    width = 1 + 2 * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        last = -1  # the range of the run before
        for batch in _with_end(batches):
            new = [] if batch is None or not batch.num_rows else [pa.Table.from_batches([batch])]
            if not new and (batch is not None or rest is None):
                continue
            table = pa.concat_tables([*([] if rest is None else [rest]), *new])
            prefix, part = _matrix(table["path"], "u1")[:, :width], table["part"].to_numpy()
            starts = np.r_[0, np.flatnonzero((prefix[1:] != prefix[:-1]).any(axis=1) | (part[1:] != part[:-1])) + 1, len(prefix)]
            of = part[starts[:-1]]
            wanted = (np.diff(starts) > 1) | (of != np.r_[last, of[:-1]]) | (of != np.r_[of[1:], -1])
            runs = len(of) if batch is None else len(of) - 1  # the last one may go on
            at = np.flatnonzero(np.repeat(wanted[:runs], np.diff(starts)[:runs]))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in prefix[at]], pa.binary()), table["node"].take(pa.array(at)).combine_chunks()], ["bucket", "node"])
            if runs:
                last = of[runs - 1]
            rest = table.slice(starts[runs])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _by_task(settle: Callable[[pa.Table, Callable], None]):
    """Streams rows sorted by task; settle(rows of a task, tell) tells what it finds as FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        out: list[list] = [[] for _ in range(4)]

        def tell(grp: int, node, links=None, root=None) -> None:
            n = len(node)
            for o, new in zip(out, ([grp] * n, node, links, root), strict=True):
                o.extend([None] * n if new is None else new)

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["grp", "node", "links", "root"])
            for o in out:
                o.clear()
            return made

        def whole(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
            task = table["task"].to_numpy()
            edges = np.r_[0, np.flatnonzero(task[1:] != task[:-1]) + 1, len(task)]
            for a, b in zip(edges[:-1], edges[1:], strict=True) if final else zip(edges[:-2], edges[1:-1], strict=True):
                if b - a > 1:
                    settle(table.slice(a, b - a), tell)
                else:
                    node = table["node"].slice(a, 1).to_pylist()
                    tell(table["grp"][int(a)].as_py(), node, [0], node)
                if len(out[0]) > 5000:
                    yield emit()
            rest[:] = [] if final else table.slice(edges[-2]).to_batches()

        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
                if rest[0]["task"][0] != batch["task"][-1]:
                    yield from whole(pa.Table.from_batches(rest), False)
        if rest:
            yield from whole(pa.Table.from_batches(rest), True)
        yield emit()

    return run


def _smallest(of: np.ndarray, names: list[bytes]) -> list[bytes]:
    """For a label a row, the smallest name among the rows that share it."""
    least: dict[int, bytes] = {}
    for label, name in zip(of.tolist(), names, strict=True):
        if label not in least or name < least[label]:
            least[label] = name
    return [least[label] for label in of.tolist()]


def connect(signs: np.ndarray, of: np.ndarray, least: float, side: np.ndarray | None = None) -> np.ndarray:
    """Labels of what alike rows connect, from the labels of what is connected already.

    A row is compared only with rows that it is not connected with yet (and of the other side, if
    sides are given), so a group of near copies costs little more than one comparison a row.
    """
    of = of.copy()
    for i in range(len(signs)):
        other = of != of[i]
        if side is not None:
            if side[i]:
                continue
            other &= side > 0
        else:
            other[: i + 1] = False
        near = np.flatnonzero(other)
        if len(near):
            hit = near[(signs[near] == signs[i]).mean(axis=1) >= least]
            if len(hit):
                of[np.isin(of, of[hit])] = of[i]
    return of


def found_chance(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The chance that two classes share a prefix of that depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def _alike(least: float):
    def settle(rows: pa.Table, tell: Callable) -> None:
        signs, nodes, grp = _matrix(rows["payload"], ">u2"), rows["node"].to_pylist(), rows["grp"][0].as_py()
        if "side" not in rows.column_names:
            of = connect(signs, np.arange(len(signs)), least)
            tell(grp, nodes, None, _smallest(of, nodes))
            return
        side, roots = rows["side"].to_numpy(), rows["root"].to_pylist()
        _, before = np.unique(np.array(roots, object), return_inverse=True)
        after = connect(signs, before, least, side)
        edges = {(a, b) for a, b in zip(roots, _smallest(after, roots), strict=True) if a != b}
        tell(grp, [a for a, _ in edges], None, [b for _, b in edges])

    return settle


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right, by products of bounded width."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float64)
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(sets), min(width, int(column[-1]) + 1 - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        common += m[: len(left)] @ m[len(left) :].T
    return common


def jaccard_at_least(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """The matrix of pairs of sets whose similarity is threshold or more."""
    common = common_counts(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common
    # in whole numbers, so that exactly the threshold counts
    return (common * 1000 >= union * round(threshold * 1000)) & (union > 0)


def _labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, a label a connected part."""
    low = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _exactly(threshold: float):
    def settle(rows: pa.Table, tell: Callable) -> None:
        nodes, copies, grp = rows["node"].to_pylist(), rows["copies"].to_numpy(), rows["grp"][0].as_py()
        sets = [np.frombuffer(p, np.uint64) for p in rows["payload"].to_pylist()]
        if "side" not in rows.column_names:
            linked = jaccard_at_least(sets, sets, threshold)
            np.fill_diagonal(linked, False)
            tell(grp, nodes, (linked @ copies).tolist(), _smallest(_labels(linked), nodes))
            return
        left, right = (np.flatnonzero(rows["side"].to_numpy() == s) for s in (0, 1))
        if not len(left) or not len(right):
            return
        linked = jaccard_at_least([sets[i] for i in left], [sets[i] for i in right], threshold)
        tell(grp, [nodes[i] for i in left], (linked @ copies[right]).tolist())
        tell(grp, [nodes[i] for i in right], (linked.T @ copies[left]).tolist())
        roots = rows["root"].to_pylist()
        a, b = np.nonzero(linked)
        names, number = np.unique(np.array(roots, object), return_inverse=True)
        edges = np.unique(number[left[a]] * len(names) + number[right[b]])
        tell(grp, [names[e // len(names)] for e in edges], None, [names[e % len(names)] for e in edges])

    return settle


def _in_blocks(members: DataFrame, settle: Callable, spread: int) -> DataFrame:
    """What settle finds inside the blocks of each group, and then between them, as FOUND.

    members has grp, node, payload, copies, and the members and bytes of the group.
    """
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def tasks(rows: DataFrame) -> DataFrame:
        return rows.repartition(spread, "task").sortWithinPartitions("task").mapInArrow(_by_task(settle), FOUND)

    inside = shared_table(tasks(placed.select(F.xxhash64("grp", "block").alias("task"), "grp", "members", "node", "copies", "payload")), "near-inside")
    large = placed.where("blocks > 1")
    if not large.select("blocks").head(1):
        return inside
    known = inside.select("grp", "node", "root")
    # a pair of blocks is a task of its own; the roots say what each block has connected inside
    large = large.join(known, ["grp", "node"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    task = F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other"))
    across = tasks(large.select(task.alias("task"), "grp", "node", "copies", "payload", "root", (F.col("block") > F.col("other")).cast("int").alias("side")))
    # a lone row of a pair of blocks tells nothing new
    return shared_table(inside.unionByName(across.where("links IS NOT NULL OR node <> root")), "near-found")


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node that it is connected with, for edges (node, root).

    Rounds of taking the neighbours' smallest label and of following labels to their labels, each
    a join and a pre-aggregated minimum, until nothing changes: a number of rounds that grows
    with the logarithm of the longest path.
    """
    # what a node is connected with is connected with the smallest of it: one edge a node, and the
    # edges between those that many nodes name together, of which few are different
    named = edges.where("node <> root").groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots"))
    named = named.select("node", F.least("node", "low").alias("low"), F.array_union("roots", F.array("node")).alias("roots"))
    edges = shared_table(named.select(F.explode("roots").alias("node"), F.col("low").alias("root")).where("node <> root").distinct(), "edges")
    both = shared_table(edges.select(F.col("node").alias("u"), F.col("root").alias("v")).union(edges.select("root", "node")).distinct(), "edges-both")
    labels = shared_table(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("least"))
        near = labels.join(near, labels["node"] == near["u"]).select("node", F.least("comp", "least").alias("comp"), (F.col("least") < F.col("comp")).alias("changed"))
        near = shared_table(near, "labels-near")
        discard(labels)
        if not near.where("changed").head(1):
            discard(both)
            return near.select("node", "comp")
        labels = shared_table(near.select("node", "comp").join(near.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp").select("node", F.col("further").alias("comp")), "labels")
        discard(near)


def measured_recall(bins: dict[int, float], found_at: int, depth: int, trees: int, threshold: float = THRESHOLD) -> float:
    """The recall of prefixes of ``depth`` on the pairs that those found at depth ``found_at`` stand for.

    bins gives, for similarities in hundredths, how many pairs were found. Where none were, all
    pairs that may be there count as being at the threshold.
    This judges a forest by pairs that are known; the join does not choose by it.
    """
    if not bins:
        return float(found_chance(np.array([threshold]), depth, trees)[0])
    s = np.array(sorted(bins)) / 100
    there = np.array([bins[b] for b in sorted(bins)]) / found_chance(s, found_at, trees)
    return float((there * found_chance(s, depth, trees)).sum() / there.sum())


def likely_components(classes: DataFrame, n: int, spread: int, threshold: float, trees: int, deepest: int, recall: float) -> tuple[DataFrame, list[tuple[int, float]]]:
    """node and comp of the classes that the forest joins, and the depths it took, each with the least recall it has."""
    values = deepest * trees
    least = threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / values))
    paths = [F.concat(F.lit(bytes([t])), F.substring("signature", 2 * deepest * t + 1, 2 * deepest)) for t in range(trees)]
    forest = classes.select("node", F.explode(F.array(*paths)).alias("path"))
    forest = forest.repartitionByRange(max(spread // 2, n * trees // RANGE_PATHS), "path", "node").sortWithinPartitions("path", "node")
    forest = shared_table(forest.withColumn("part", F.spark_partition_id()), "near-forest")
    depth, took, edges, comps = deepest, [], None, None
    while True:
        runs = shared_table(forest.mapInArrow(_runs(depth), "bucket binary, node binary"), "near-runs")
        comp = F.col("node") if comps is None else F.coalesce("comp", "node")
        known = runs if comps is None else runs.join(comps, "node", "left")
        buckets = known.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("print"), F.sum(F.xxhash64("node") % 1_000_003).alias("sum"), F.min(comp).alias("a"), F.max(comp).alias("b"))
        # trie nodes of one class, or of classes that are joined already, have nothing to add; those with the same members are looked at once
        buckets = buckets.where("members > 1 AND a <> b").groupBy("members", "print", "sum").agg(F.min("bucket").alias("bucket"))
        buckets = shared_table(buckets.select("bucket", "members", F.lit(0).alias("bytes")), "near-buckets")
        members = join_hot(runs, buckets, "bucket", "members", n * trees).join(classes.select("node", "signature"), "node")
        members = members.select(F.xxhash64("bucket").alias("grp"), "members", "bytes", "node", F.lit(1).cast("long").alias("copies"), F.col("signature").alias("payload"))
        found = _in_blocks(members, _alike(least), spread)
        new = found.where("node <> root").select("node", "root")
        edges = new if edges is None else edges.unionByName(new)
        comps = components(edges)
        took.append((depth, float(found_chance(threshold, depth, trees))))
        discard(runs, buckets)
        if took[-1][1] >= recall or depth == 1:
            return comps, took
        # as short as pairs at the threshold ask for
        depth = next((d for d in range(depth - 1, 1, -1) if found_chance(threshold, d, trees) >= recall), 1)


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), text_of())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part["node"], part["comp"], part["copies"], pa.array([shingles(t).tobytes() for t in part["text"].to_pylist()], pa.binary())], ["node", "comp", "copies", "payload"])


def _joined(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> DataFrame:
    """doc_id, row_key, class_id, n_links and first (whether the row is its class's first), one row per row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("row_key", _row_key())
    rows = shared_table(texts.mapInArrow(_signed(trees * deepest), "doc_id long, row_key long, node binary, signature binary"), "near-rows")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")).alias("head")
    classes = shared_table(rows.where("node IS NOT NULL").groupBy("node").agg(head, F.count("*").alias("copies"), F.any_value("signature").alias("signature")), "near-classes")
    n = classes.count()
    spread = max(2 * docs.sparkSession.sparkContext.defaultParallelism, n // 5000)
    likely, _ = likely_components(classes, n, spread, threshold, trees, deepest, recall)

    wanted = shared_table(likely.join(classes.select("node", F.col("head.doc_id").alias("head_id"), F.col("head.row_key").alias("head_key"), "copies"), "node"), "near-wanted")
    # always a shuffled join: a broadcast would turn into one as the classes grow
    found = texts.join(wanted.hint("merge"), (texts["row_key"] == wanted["head_key"]) & texts["doc_id"].eqNullSafe(wanted["head_id"])).select("node", "comp", "copies", "text").mapInArrow(_sets, "node binary, comp binary, copies long, payload binary")
    found = shared_table(found.dropDuplicates(["node"]), "near-sets")
    sizes = shared_table(found.groupBy("comp").agg(F.count("*").alias("members"), F.sum(F.octet_length("payload")).alias("bytes")), "near-sizes")
    members = join_hot(found, sizes, "comp", "members", n).withColumn("grp", F.xxhash64("comp"))
    checked = _in_blocks(members.select("grp", "members", "bytes", "node", "copies", "payload"), _exactly(threshold), spread)
    links = checked.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(checked.where("node <> root").select("node", "root"))
    named = comps.join(classes.select("node", "head"), "node").groupBy("comp").agg(F.min("head").alias("head"), F.count("*").alias("members"))
    named = shared_table(join_hot(comps, shared_table(named, "near-heads"), "comp", "members", n).select("node", F.col("head").alias("class_head")), "near-named")
    discard(found, sizes, wanted)
    info = classes.select("node", "head", "copies").join(links, "node", "left").join(named, "node", "left")
    info = shared_table(info.select("node", "copies", F.coalesce("class_head", "head").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-info")
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row_key") == F.col("head.row_key"))
    linked = join_hot(rows.select("doc_id", "row_key", "node").where("node IS NOT NULL"), info, "node", "copies", n).select("doc_id", "row_key", F.col("head.doc_id").alias("class_id"), "n_links", same.alias("first"))
    return linked.unionByName(rows.where("node IS NULL").select("doc_id", "row_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and n_links, one row per row of docs.

    n_links is the number of other documents with a similarity of threshold or more; class_id is
    the smallest doc_id that the document is connected with through such links.
    """
    return _joined(docs, **options).select("doc_id", "class_id", "n_links")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id, and one row of it.

    Rows with a null doc_id all stay, and rows without words stay once.
    """
    rows = _joined(docs, **options).where("doc_id IS NOT NULL")
    per = shared_table(rows.groupBy("doc_id", "row_key").agg(F.bool_or("first").alias("first"), F.count("*").alias("times")).where("NOT first OR times > 1"), "near-gone")
    mine = carried(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text_of("row.text").alias("text"))
    mine = mine.select("row", "doc_id", F.xxhash64("doc_id", "text").alias("row_key"))
    # most rows are in neither list, and go their way without a shuffle as long as the lists are short
    stay = mine.join(per.select("doc_id", "row_key"), ["doc_id", "row_key"], "left_anti")
    again = mine.join(per.where("first").select("doc_id", "row_key"), ["doc_id", "row_key"], "left_semi").groupBy("doc_id", "row_key").agg(F.first("row").alias("row"))
    return stay.select("row").unionByName(again.select("row")).select("row.*")
