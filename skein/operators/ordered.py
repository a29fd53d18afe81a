"""Running values along one order of a whole table, without a task per key.

``placed`` deals rows by range of the order, so a key with any share of them spreads over partitions, and stores them
with partition and row number. Values then run within a partition; what crosses to the next one travels in a table
of one row a partition (or of one row a key and partition), which is all that is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.storage import materialize

PART, ROW = "part_", "row_"
BACK = (Window.unboundedPreceding, Window.currentRow)


def placed(rows: DataFrame, order: list[str | Column], name: str = "placed") -> DataFrame:
    """``rows`` in the order of those columns, stored with ``part_`` and ``row_`` (from 1 within it). Ties have no order of their own."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())
    # this id counts a partition's rows from its number times 2**33; stored, so that later passes need not deal and sort for it
    return materialize(ordered.withColumn(ROW, F.monotonically_increasing_id() - F.shiftleft(F.col(PART).cast("bigint"), 33) + 1), name)


def _carried(rows: DataFrame, value: Column, name: str, onward: bool) -> DataFrame:
    """part_ and the last (or first, where not ``onward``) value that isn't null in the parts before (or behind) it."""
    end = (F.max_by if onward else F.min_by)(value, F.when(value.isNotNull(), F.col(ROW)))
    ends = rows.groupBy(PART).agg(end.alias("end_"))  # a row a partition
    over = Window.orderBy(F.col(PART) if onward else F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(PART, F.last("end_", ignorenulls=True).over(over).alias(name))


def _across(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(table), PART)  # a row a partition


def before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the value of the row before, whichever partition it is in."""
    over, filled = Window.partitionBy(PART).orderBy(ROW), F.struct(value.alias("v"))
    out = _across(rows, _carried(rows, filled, "carried_", onward=True)).withColumn("lagged_", F.lag(filled).over(over))
    return out.withColumn(name, F.coalesce("lagged_", "carried_")["v"]).drop("lagged_", "carried_")


def latest(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null, up to and with this row."""
    over = Window.partitionBy(PART).orderBy(ROW).rowsBetween(*BACK)
    out = _across(rows, _carried(rows, value, "carried_", onward=True))
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(over), "carried_")).drop("carried_")


def following(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the first value that isn't null, from this row on."""
    over = Window.partitionBy(PART).orderBy(F.col(ROW).desc()).rowsBetween(*BACK)
    out = _across(rows, _carried(rows, value, "carried_", onward=False))
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(over), "carried_")).drop("carried_")


def running_sum(rows: DataFrame, value: Column, name: str, by: str) -> DataFrame:
    """Adds the sum of ``value`` up to and with this row among rows of equal ``by``; these stand next to each other in the order."""
    within = F.sum(value).over(Window.partitionBy(PART, by).orderBy(ROW).rowsBetween(*BACK))
    sums = rows.groupBy(PART, by).agg(F.sum(value).alias("sum_"))  # a key has at most a row a partition
    offset = F.coalesce(F.sum("sum_").over(Window.partitionBy(by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col(PART).alias("other_"), F.col(by).alias("by_"), offset.alias("offset_"))
    out = rows.withColumn("within_", within).join(offsets, (F.col(PART) == F.col("other_")) & F.col(by).eqNullSafe(F.col("by_")))
    return out.withColumn(name, F.col("within_") + F.col("offset_")).drop("within_", "offset_", "other_", "by_")


def position(rows: DataFrame, name: str) -> DataFrame:
    """Adds the row's number in the whole order, from 0."""
    sizes = rows.groupBy(PART).agg(F.count("*").alias("n_"))
    start = F.coalesce(F.sum("n_").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _across(rows, sizes.select(PART, start.alias("start_"))).withColumn(name, F.col("start_") + F.col(ROW) - 1).drop("start_")


def reached(starts: DataFrame, links: DataFrame, name: str = "reached", rounds: int = 64) -> DataFrame:
    """(at): the starts and all that their links lead to, one link (at, to) a place: by doubling.

    Links of 2**k places are joined to links twice as long, up to the first that leave no start; then the places in
    between are filled in, from the longest links down. A chain of n links takes log2(n) joins each way, and no place
    is followed alone. A place that stands 2**k links or more behind a start is the end of such a link, so the longer
    links are only made from starts and such ends, which grow fewer where chains meet.
    """
    starts = materialize(starts.select("at").distinct(), name)
    levels = [materialize(links.select("at", "to"), f"{name}-links")]
    n = levels[0].count()  # no place is further away, also where links go in circles
    while 2 ** (len(levels) - 1) <= n and not (links := levels[-1]).join(starts, "at", "left_semi").isEmpty():
        if len(levels) > rounds:
            raise ValueError(f"{name}: links don't end")
        needed = links.select(F.col("to").alias("at")).union(starts).distinct()
        first = links.join(needed, "at", "left_semi")
        levels.append(materialize(first.join(links.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to")), f"{name}-links"))
    known = starts
    for links in reversed(levels[:-1]):
        known = materialize(known.union(links.join(known, "at", "left_semi").select("to")).distinct(), name)
    return known
