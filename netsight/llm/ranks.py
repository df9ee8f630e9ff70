"""Places of rows within their group, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsight.llm.common import shared

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ranked(rows: DataFrame, group: str, order: list[str], place: str) -> DataFrame:
    """Adds ``place``: 0, 1, 2, … within each ``group``, in the order of ``order``, nulls first.

    ``rows`` must be a stored table, since it is read twice (the ranges are sampled). Its row
    numbers are the last part of the order, so equal rows have places of their own and a group of
    any size is dealt over many ranges. A range's rows are numbered where they lie; what comes
    before them is added from one count for each (range, group), at most groups plus ranges in all.
    """
    keys = [group, *order, "_row"]
    dealt = (rows.withColumn("_row", F.monotonically_increasing_id())
             .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row"))
    placed = shared(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_at", _ROW_BITS))
    counts = placed.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (placed.join(counts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
            .withColumn(place, F.col("_before") + F.col("_at") - F.col("_first"))
            .select(*rows.columns, place))
