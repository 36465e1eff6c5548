"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group and stay together. Groups go, largest first, to the least
loaded shard through a heap. The heap needs the sizes alone: it works on their histogram, where
equal groups are dealt in one step as far as the heap would deal them in turns. Sizes from
``EXACT`` bytes on are put in classes that differ by one part in ``CLASSES`` and count with their
mean, so the histogram has a bounded number of rows however many groups there are. The groups of
a class are then numbered without gaps, over all machines, and each number names its shard.

Defined results: a null text counts as the empty text (size 1) and shares its group; groups of
equal size tie by a hash of their text, equally loaded shards by their number; repeated rows are
documents of their own in the same shard; a group larger than a fair share gets a shard that
takes little else; a very long text is only measured and hashed; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, dense_number, join_hot, shared_table, text_of

#: Sizes below EXACT are classes of their own; e times as large a size is CLASSES classes further.
EXACT, CLASSES = 1 << 16, 4096


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard takes if each goes to the least loaded one, ties to the lower number.

    The heap takes the ``count`` smallest of all loads that the shards pass through. Whole rounds
    below a common level are counted at once; the heap deals the rest, less than one a shard.
    """

    def below(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load in loads]

    low, high = min(loads), min(loads) + size * count + 1
    while high - low > 1:  # the highest level with no more than ``count`` loads below it
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    taken = below(low)
    heap = [(load + size * n, shard) for shard, (load, n) in enumerate(zip(loads, taken, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, shard = heap[0]
        taken[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return taken


def plan(histogram: Iterable[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, shard, first number, end) from (class, groups, their bytes)."""
    loads, out = [0] * shards, []
    for size_class, count, total in sorted(histogram, reverse=True):
        at = 0
        for shard, many in enumerate(deal(loads, max(1, round(total / count)), count)):
            if many:
                loads[shard] += round(total * many / count)
                out.append((size_class, shard, at, at + many))
                at += many
    return out


def shard_documents(docs: DataFrame, shards: int = 8, classes: int | None = CLASSES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, one row per row of docs.

    classes is how finely sizes from EXACT bytes on are told apart. None tells each size apart, as
    a plain heap would: then the histogram has as many rows more as there are sizes from EXACT bytes on.
    """
    text = text_of()
    rows = shared_table(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_key")),
        "shard-rows",
    )
    n = rows.count()
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"))
    further = F.col("bytes") if classes is None else F.lit(EXACT) + F.floor(F.log(F.col("bytes") / EXACT) * classes)
    groups = shared_table(groups.withColumn("class", F.when(F.col("bytes") < EXACT, F.col("bytes")).otherwise(further).cast("long")), "shard-groups")
    # at most EXACT rows and CLASSES for each time that sizes grow by e
    histogram = [tuple(r) for r in groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()]
    places = docs.sparkSession.createDataFrame(plan(histogram, shards), "class long, shard int, begin long, until long")
    numbered = dense_number(groups, ["class"], ["text_key"], "number", buckets_for(n))
    # as bounded as the histogram, times the shards
    placed = numbered.join(F.broadcast(places), "class").where("number >= begin AND number < until").select("text_key", "shard", "copies")
    out = join_hot(rows, shared_table(placed, "shard-placed"), "text_key", "copies", n).withColumn("order", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = shared_table(out.withColumn("twin", F.monotonically_increasing_id()), "shard-out")
    out = dense_number(out, ["shard"], ["order", "twin"], "slot", buckets_for(n))
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
