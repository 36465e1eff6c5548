"""Running sums and maxima along an order, for groups of any size.

Rows are dealt by their group and sorted inside it once. Only groups of more than MOST rows are
range-partitioned by group and order, so one with most of all rows lies in many ranges. What is to be added up inside a range is a window over (group, range); what the ranges
before it add is one row a group and range, and its running value is joined back. So no task
sees more than a range, and an interval that is open where a range begins is carried into it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled

#: Rows of a group that one task sorts.
MOST = 500_000
_OF = {"sum": F.sum, "max": F.max}


def ranged(rows: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows in ranges along order, each with its number in _range; computed once, for the ranges must not change."""
    # rows that order does not tell apart are spread by all that they hold, the same in every run
    salted = rows.withColumn("_salt", F.xxhash64(*rows.columns))
    count = [] if ranges is None else [ranges]
    return settled(salted.repartitionByRange(*count, *order, "_salt").drop("_salt").withColumn("_range", F.spark_partition_id()))


def swept(rows: DataFrame, asks: Column, group: Sequence[str], order: Sequence[str], ranges: int | None = None, counted: DataFrame | None = None, **running: tuple[str, Column]) -> DataFrame:
    """The rows that ask, with a column for each of running: the sum or max ("sum", "max") of an
    expression over all rows of the group that order puts before the row. A sum over nothing is 0, a max null.

    Rows that ask add nothing themselves, and order never puts one level with a row that does not: then rows
    that it does put level may lie in different ranges, however many they are. ranges puts all groups into so
    many ranges. counted has the columns of group, ``_n`` and ``_tells``, which add up to no less than the group's
    rows and those of them that do not ask; it is for callers who can tell that without computing the rows.
    """
    if ranges is not None:
        return _in_ranges(rows, asks, group, order, ranges, running)
    sizes = rows.select(*group, F.lit(1).alias("_n"), F.when(asks, 0).otherwise(1).alias("_tells")) if counted is None else counted
    sizes = sizes.groupBy(*group).agg(F.sum("_n").alias("_n"), F.sum("_tells").alias("_tells")).where(F.col("_n") > MOST)
    large = settled(sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_tells"))
    if large.isEmpty():
        return _by_group(rows, asks, group, order, running)
    same = _same(group)
    found = _by_group(rows.join(F.broadcast(large), same, "left_anti"), asks, group, order, running)
    # a large group in which all rows ask, as of a holder that nobody knows, needs no order
    told = large.where("_tells > 0")
    none = rows.where(asks).join(F.broadcast(large.where("_tells = 0")), same, "left_semi")
    nothing = {c: (F.lit(0) if k == "sum" else F.lit(None)).cast(found.schema[c].dataType) for c, (k, _) in running.items()}
    found = found.unionByName(none.withColumns(nothing))
    if told.isEmpty():
        return found
    return found.unionByName(_in_ranges(rows.join(F.broadcast(told), same, "left_semi"), asks, group, order, None, running))


def _same(group: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])


def _by_group(rows: DataFrame, asks: Column, group: Sequence[str], order: Sequence[str], running: dict[str, tuple[str, Column]]) -> DataFrame:
    inside = Window.partitionBy(*group).orderBy(*order)
    # dealt before the values are computed, so that only the rows themselves travel
    told = rows.repartition(*group).withColumns({c: _OF[k](value).over(inside) for c, (k, value) in running.items()}).where(asks)
    return told.select(*rows.columns, *[(F.coalesce(c, F.lit(0)) if k == "sum" else F.col(c)).alias(c) for c, (k, _) in running.items()])


def _in_ranges(rows: DataFrame, asks: Column, group: Sequence[str], order: Sequence[str], ranges: int | None, running: dict[str, tuple[str, Column]]) -> DataFrame:
    laid = ranged(rows.withColumns({f"_v_{c}": value for c, (_, value) in running.items()}), [*group, *order], ranges)
    kinds = {c: kind for c, (kind, _) in running.items()}
    of = _OF
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy(*group, "_range").agg(*[of[k](f"_v_{c}").alias(f"_s_{c}") for c, k in kinds.items()])
    names = [F.col(g).alias(f"_g_{g}") for g in group]
    base = sums.select(*names, F.col("_range").alias("_r"), *[of[k](f"_s_{c}").over(before).alias(f"_b_{c}") for c, k in kinds.items()])
    own = laid.withColumns({f"_o_{c}": of[k](f"_v_{c}").over(inside) for c, k in kinds.items()})
    both = own.where(asks).join(base, _same(group) & (F.col("_range") == F.col("_r")))
    total = {c: F.coalesce(f"_o_{c}", F.lit(0)) + F.coalesce(f"_b_{c}", F.lit(0)) if k == "sum" else F.greatest(f"_o_{c}", f"_b_{c}") for c, k in kinds.items()}
    return both.select(*rows.columns, *[value.alias(c) for c, value in total.items()])


def edges(intervals: DataFrame, begin: str, end: str, *keys: str) -> DataFrame:
    """keys, at and delta: +1 where an interval begins, -1 where it ends (null: never); those that end before they begin hold nothing."""
    real = intervals.where(F.col(begin).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(begin))))
    starts = real.select(*keys, F.col(begin).alias("at"), F.lit(1).alias("delta"))
    return starts.unionByName(real.where(F.col(end).isNotNull()).select(*keys, F.col(end).alias("at"), F.lit(-1).alias("delta")))


def covered(asks: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, begin: str, end: str, ranges: int | None = None) -> DataFrame:
    """asks with ``open``: how many half-open intervals [begin, end) of the same keys cover the instant in column ``at``."""
    row = F.struct(*asks.columns)
    asked = asks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(at).alias("at"), F.lit(1).alias("_asks"), F.lit(0).alias("delta"), row.alias("_row"))
    borders = edges(intervals, begin, end, *keys)
    marks = borders.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "at", F.lit(0).alias("_asks"), "delta", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    # an interval is open at its very beginning and closed at its end, so its borders come before what is asked there
    out = swept(asked.unionByName(marks), F.col("_asks") == 1, [f"_k_{k}" for k in keys], ["at", "_asks"], ranges, open=("sum", F.col("delta")))
    return out.select("_row.*", "open")
