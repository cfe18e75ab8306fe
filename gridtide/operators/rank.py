"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridtide.plans.work import written

# monotonically_increasing_id: the number of the task above these bits, the row within it below.
_ROW_BITS = 33


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "Rank") -> DataFrame:
    """Add the place of each row, from 1, in this order, which must leave no ties.

    Spark sorts by ranges, so every task holds one stretch of the order. The sorted rows are stored
    with their place within the task; the number of rows of each task, as many values as there were
    tasks, gives the places at which the tasks start.
    """
    place = f"place_of_{'_'.join(rows.columns)}"
    stored = written(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()))
    task = F.shiftright(place, _ROW_BITS)
    counts = stored.groupBy(task.alias("task")).count().orderBy("task").collect()
    starts, before = [], 0
    for number, count in counts:
        starts.append((number, before))
        before += count
    offsets = rows.sparkSession.createDataFrame(starts, "__task bigint, __start bigint")
    row = F.col(place).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = stored.withColumn("__task", task).join(F.broadcast(offsets), "__task")
    kind = "int" if before < 2**31 else "bigint"
    return placed.withColumn(name, (F.col("__start") + row + 1).cast(kind)).drop("__task", "__start", place)
