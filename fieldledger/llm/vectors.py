"""What the searches over embeddings share: which vectors take part, and query and base blocks.

A search sets every query against all rows in blocks. A first block of at most ``FIRST_ROWS`` rows,
drawn by a hash, answers all queries; the k-th value of that answer goes with each query to the
base blocks of all other rows, so that every block prunes by a bound that is already close. Blocks
are bounded in bytes, whatever the width of the vectors; each pair of a base block and a query
block is one group and gives at most k rows a query, which are then merged. Many equal vectors are
no more than many rows of their blocks. Vectors meet vectors of their own width only.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

#: Bytes of a base block and of a query block.
BLOCK_BYTES, QUERY_BYTES = 64 << 20, 16 << 20
#: Rows of the first block, on average at most.
FIRST_ROWS = 4096
#: Every row whose id this divides is a query.
QUERY_EVERY = 20
TOP_K = 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats or doubles as they came) and width of the vectors that take part.

    Left out: null ids, null, empty and zero vectors, and vectors with null or non-finite
    components. Of rows that share an id, the one whose components sort last takes part.
    """
    limit = F.lit(float("inf"))
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kept = "float" if kind == "float" else "double"
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kept}>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("embedding", lambda x: x != 0)
    )
    twice = shared_table(fine.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "vectors-twice")
    one = fine.join(twice, "vec_id", "left_anti").unionByName(fine.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.max("embedding").alias("embedding")))
    return one.withColumn("width", F.size("embedding"))


def in_blocks(rows: DataFrame, search: Callable[[pa.Table], pa.Table], schema: str, value: str, descending: bool, row_bytes: Callable, wide: bool, every: int = QUERY_EVERY, k: int = TOP_K) -> DataFrame:
    """The k best rows of each query by ``value``, ties to the smaller vec_id, with their rank.

    search(group) gives a group's own best as query_id, vec_id and value, no pair twice. It sees the
    columns of rows with ``asks`` (true for queries) and ``bound`` (a value of k rows that are
    known already, null for none). row_bytes tells the memory a row of some width takes; wide
    rows are dealt to more base blocks and narrow ones met by more query blocks where more tasks
    are wanted.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ids = F.xxhash64("vec_id")
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("nq"))
    size = row_bytes(F.col("width"))
    least = F.lit(cores if wide else 1), F.lit(1 if wide else 2 * cores)
    widths = widths.withColumn("base", F.greatest(F.ceil(F.col("n") * size / BLOCK_BYTES), F.least(F.col("n"), least[0])).cast("int"))
    widths = widths.withColumn("asked", F.greatest(F.ceil(F.col("nq") * size / QUERY_BYTES), F.least(F.col("nq"), least[1]), F.lit(1)).cast("int"))
    widths = widths.withColumn("spread", F.greatest(F.col("asked"), F.least(F.col("nq"), F.lit(2 * cores)), F.lit(1)).cast("int"))
    widths = shared_table(widths, "vectors-widths")
    tasks = widths.agg(F.coalesce(F.sum(F.col("base") * F.col("asked")), F.lit(1)).alias("t")).first()["t"]
    place = F.pmod(F.xxhash64(F.lit("place"), "vec_id"), F.col("n"))
    dealt = rows.join(widths, "width").withColumn("first", place < FIRST_ROWS)
    dealt = dealt.withColumn("base_block", F.when(F.col("first"), -1).otherwise(F.pmod(ids, F.col("base"))).cast("int"))
    none = F.lit(None).cast("double").alias("bound")
    names = rows.columns

    def searched(stock: DataFrame, asking: DataFrame, parts: int) -> DataFrame:
        both = stock.select(*names, F.lit(False).alias("asks"), none, "base_block", "query_block").unionByName(asking.select(*names, F.lit(True).alias("asks"), "bound", "base_block", "query_block"))
        # an explicit number of partitions: groups weigh little in bytes and much in time, and must not be merged
        return both.repartition(4 * parts, "width", "base_block", "query_block").groupBy("width", "base_block", "query_block").applyInArrow(search, schema)

    def blocks(of: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    queries = dealt.where(F.col("vec_id") % every == 0)
    mine = F.pmod(ids, F.col("spread")).cast("int")
    start = searched(dealt.where("first").withColumn("query_block", blocks("spread")), queries.withColumn("base_block", F.lit(-1)).withColumn("query_block", mine).withColumn("bound", none), 2 * cores)
    start = shared_table(start, "vectors-first")
    worst = (F.min if descending else F.max)(value)
    bounds = start.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("have"), worst.cast("double").alias("bound")).where(F.col("have") >= k).select("vec_id", "bound")
    asking = queries.join(bounds, "vec_id", "left").withColumn("query_block", F.pmod(ids, F.col("asked")).cast("int")).drop("base_block").withColumn("base_block", blocks("base"))
    rest = searched(dealt.where("NOT first").withColumn("query_block", blocks("asked")), asking, min(tasks, 50_000))
    ordered = Window.partitionBy("query_id").orderBy(F.desc(value) if descending else F.col(value), "vec_id")
    return start.unionByName(rest).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
