"""Places of rows in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialise


def positions(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``pos``, a row's place from 0 in its group, and ``n``, the group's rows.

    Ascending order, nulls first; rows equal in all of ``order`` stand in any
    order. Group columns must not be null. Rows are dealt by ranges of group and
    order, so one group lies in as many tasks as its size asks for; only one
    count per range and group is summed up. Reads ``df`` twice (once for the
    bounds of the ranges): hand in a table or a cheap plan.
    """
    keys = [*group, *order, "__tie"]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    # In this stage the id's upper bits number the range, its lower 33 bits the row in it.
    kept = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()), label)
    kept = kept.withColumn("__range", F.shiftrightunsigned("__at", 33))
    runs = kept.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "__range", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("n"))
    placed = kept.join(runs, [*group, "__range"])
    return placed.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__range", "__first", "__before")
