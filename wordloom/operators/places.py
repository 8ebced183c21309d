"""Places in an order over a whole table: numbers and running sums that no task makes alone.

Rows are dealt to tasks by ranges of the order (sampled, so that equal shares land in each), every task
counts or sums its own, and what stands before a task is the sum over the tasks before it: a table of one
row a task. The dealt rows are written first, as ranges sampled anew need not be the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.sources.tables import written

#: monotonically_increasing_id() is the task's number, so many bits up, and the row's number in its task.
TASK_BITS = 33


def by_range(df: DataFrame, order: list[str | Column]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def before_tasks(table: DataFrame, task: Column, size: Column) -> DataFrame:
    """task, base: the sum of size over all tasks before. One row a task, so it may be summed by one and broadcast."""
    totals = table.groupBy(task.alias("task")).agg(F.sum(size).alias("total"))
    before = F.sum("total").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("task", F.coalesce(before, F.lit(0)).cast("long").alias("base"))


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df and the column name: each row's number in the order, from 1. No two rows may be alike in the order's columns."""
    table = written(by_range(df, order).withColumn("_at", F.monotonically_increasing_id()), "places")
    task = F.shiftright("_at", TASK_BITS)
    base = before_tasks(table, task, F.lit(1))
    own = F.col("_at").bitwiseAND((1 << TASK_BITS) - 1)
    return table.withColumn("task", task).join(F.broadcast(base), "task").select(*df.columns, (F.col("base") + own + 1).alias(name))


def running(df: DataFrame, order: list[str | Column], size: str, name: str) -> DataFrame:
    """df and the column name: the sum of the column size (long) over all rows before, in the order."""
    ranged = by_range(df, order)
    fields = list(df.columns)
    at = fields.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            before = upto + np.cumsum(own) - own
            upto += int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), task, np.int64)), pa.array(before)], names=[*fields, "_task", "_before"])

    schema = ranged.withColumns({"_task": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")}).schema
    table = written(ranged.mapInArrow(run, schema), "running")
    base = before_tasks(table, F.col("_task"), F.col(size))
    return table.join(F.broadcast(base), F.col("_task") == F.col("task")).select(*fields, (F.col("base") + F.col("_before")).alias(name))
