"""Consecutive numbers without a single-task window."""

from pyspark.sql import DataFrame, Window, functions as F

from trendloom.session import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in the low 33 bits


def with_rank(df: DataFrame, order: list[str], column: str = "seq", start: int = 1) -> DataFrame:
    """Number all rows by ``order``: range partitions are sorted on their own, then shifted by the sizes before them.

    The sorted rows are written once, so the numbers cannot change when a task is run again. The only window
    runs over one row per partition.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(spread.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    numbered = (numbered.withColumn("_part", F.shiftright("_id", _ROW_BITS))
                .withColumn("_row", F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One offset row per range partition: at most the number of shuffle partitions.
    ranked = numbered.join(F.broadcast(offsets), "_part")
    return ranked.withColumn(column, F.col("_row") + F.col("_offset") + F.lit(start)).select(*df.columns, column)


def allocate(new: DataFrame, max_id: int, order: list[str], column: str = "cluster_id") -> DataFrame:
    """Next ids after ``max_id`` in the given order."""
    return with_rank(new, order, column, start=max_id + 1)


def rank_within(df: DataFrame, group: str, order: list[str], column: str = "rank") -> DataFrame:
    """1, 2, 3 … within each group, for groups of any size."""
    ranked = with_rank(df, [group, *order], "_all")
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_all").alias("_first"))
    joined = ranked.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(column, F.col("_all") - F.col("_first") + 1).select(*df.columns, column)
