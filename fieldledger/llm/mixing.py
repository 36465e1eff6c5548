"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document is a packet in the queue of its source. The queue is shuffled by a hash of the
document and its virtual finish time is the words of its source up to and with it, divided by
the target of the source. Documents leave in order of virtual finish time until the budget is
spent. A source whose target exceeds its words is queued again after its own end, in the same
shuffled order, up to ``max_repeats`` times.

Defined results: a null text has size 0 and is never short of its (zero) share; null sources
form one source that sorts last; repeated rows are separate documents, and so are rows with a null
doc_id; equal virtual finish times tie by source, copy and place in the shuffled queue; a very long
text is taken whole or not at all, so a target may be missed by its size; an empty table gives an
empty result; other columns, whatever their names, are left alone (``mix`` returns only the
named ones).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, buckets_for, carried, join_hot, running_sum, shared_table, text_of

#: Runs of characters outside space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2


def shuffle_key(seed: int) -> Column:
    """A place in the shuffled queue that depends on the document and the seed alone.

    Rows without an id of their own (null, or one of a very common id) are shuffled one by one.
    """
    own = F.when(F.col("doc_id").isNull() | F.col("common"), F.concat_ws("/", F.lit("row"), F.col("doc_id").cast("string"), F.col("twin").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return F.md5(F.concat(own, F.lit(f":{seed}")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source_key, source_size and target.

    Water filling in closed form: with sources sorted by cap / weight, a source is held at its
    cap exactly if the budget still covers all caps up to it plus its own level for the rest.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    whole = Window.partitionBy(F.lit(0))
    upto = Window.orderBy("ratio", "source_key")
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    per = per.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget)))
    per = per.withColumn("caps", F.sum("cap").over(upto)).withColumn("rest", F.sum("weight").over(whole) - F.sum("weight").over(upto))
    per = per.withColumn("held", F.col("caps") + F.col("ratio") * F.col("rest") <= F.col("total"))
    held_caps = F.sum(F.when(F.col("held"), F.col("cap")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("weight"))).over(whole)
    level = (F.col("total") - held_caps) / F.when(free > 0, free)
    target = F.when(F.col("held"), F.col("cap")).otherwise(F.col("weight") * level)
    return per.select("source_key", "source_size", target.alias("target"))


def sized(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source_key (null sorts last), size and the shuffle key, without the text."""
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    return docs.select("doc_id", key.alias("source_key"), size.alias("size"), *extra)


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, times and first_finish, one row per document.

    taken counts words with repeats; first_finish is the virtual finish time of the first copy.
    """
    queue = shared_table(sized(docs, extra).withColumn("twin", F.monotonically_increasing_id()), "mix-sizes")
    rows = queue.count()
    # fewer than HOT_SHARE ids, whatever the data
    common = queue.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max(1000, rows // HOT_SHARE))
    common = shared_table(common.select(F.col("doc_id").alias("common_id")), "mix-common")
    queue = queue.join(F.broadcast(common), F.col("doc_id") == F.col("common_id"), "left").withColumn("common", F.col("common_id").isNotNull())
    queue = queue.withColumn("shuffled", shuffle_key(seed)).drop("common", "common_id")
    per = shared_table(targets(queue, weights, budget, max_repeats), "mix-targets")
    # the digest's leading 32 bits as buckets: the order of the queue is that of the digests
    lead = F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("double") * buckets_for(rows) / 2**32).cast("long")
    queue = running_sum(queue, ["source_key"], ["shuffled", "twin"], "size", "before", buckets_for(rows), lead)
    # a source list is as long as there are sources, so Spark picks the join by its size
    queue = queue.join(per, "source_key").withColumn("end", F.col("before") + F.col("size"))
    queue = shared_table(queue, "mix-queue")

    # virtual time runs from 0 to max_repeats and beyond; a grid over it deals the global order out in ranges
    grid = buckets_for(rows)

    def finish(times: int) -> Column:
        return F.when(F.col("target") > 0, (F.col("end") + F.col("source_size") * times) / F.col("target")).otherwise(0.0)

    def cell(at: Column) -> Column:
        return F.least(F.floor(at * grid), F.lit(8 * grid)).cast("long")

    copies = F.explode(F.array(*[F.struct(F.lit(t).alias("copy"), finish(t).alias("finish")) for t in range(max_repeats)]))
    stream = queue.select("doc_id", "source_key", "size", "shuffled", "twin", copies.alias("c")).select("*", "c.copy", "c.finish", cell(F.col("c.finish")).alias("cell")).drop("c")
    total = F.floor(F.sum("source_size") * F.lit(float(budget)))
    limit = per.agg(total.alias("total"))
    cells = stream.groupBy("cell").agg(F.sum("size").alias("cell_size"))
    up_to = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("passed", F.coalesce(F.sum("cell_size").over(up_to), F.lit(0)))
    # the one cell in which the budget ends; only its documents are ordered one by one
    edge = cells.join(limit, (F.col("passed") <= F.col("total")) & (F.col("passed") + F.col("cell_size") > F.col("total")))
    edge_row = edge.select("cell", "passed", "total").head()
    if edge_row is None:
        last_cell, cut = 8 * grid + 1, None
    else:
        last_cell = edge_row["cell"]
        inside = Window.partitionBy("cell").orderBy("finish", "source_key", "copy", "shuffled", "twin")
        at = stream.where(F.col("cell") == last_cell).withColumn("sum", F.sum("size").over(inside) + F.lit(edge_row["passed"]))
        cut = at.where(F.col("sum") <= F.lit(edge_row["total"])).agg(F.max(F.struct("finish", "source_key", "copy", "shuffled", "twin")).alias("m")).head()["m"]

    def goes(times: int) -> Column:
        at = finish(times)
        early = cell(at) < last_cell
        if cut is None:
            return early
        missing, name = cut["source_key"]["missing"], cut["source_key"]["name"]
        mine = F.struct(at.alias("finish"), F.col("source_key"), F.lit(times).alias("copy"), F.col("shuffled"), F.col("twin"))
        last = F.struct(F.lit(cut["finish"]).alias("finish"), F.struct(F.lit(missing).alias("missing"), F.lit(name).alias("name")).alias("source_key"), F.lit(cut["copy"]).alias("copy"), F.lit(cut["shuffled"]).alias("shuffled"), F.lit(cut["twin"]).alias("twin"))
        return early | (mine <= last)

    times = reduce(lambda a, b: a + b, [goes(t).cast("long") for t in range(max_repeats)])
    out = queue.withColumn("times", F.when(F.col("target") > 0, times).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", finish(0).alias("first_finish"), "shuffled", *extra)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, a document taken twice being there twice.

    Rows that repeat both id and text share one decision: the most copies that any of them was
    given.
    """
    rows = carried(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), text_of("row.text").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    taken = mix(rows.select("doc_id", "source", "text", "row_key"), extra=("row_key",), **options)
    taken = shared_table(taken.groupBy("row_key").agg(F.max("times").alias("times"), F.count("*").alias("copies")).where("times > 0"), "mix-taken")
    kept = join_hot(rows.select("row", "row_key"), taken, "row_key", "copies", docs.count())
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
