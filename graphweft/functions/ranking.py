"""Ranks over a whole table without sending it through one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphweft.functions.storage import materialise

#: Bits of monotonically_increasing_id that count rows within a task.
ROW_BITS = 33


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows dealt by ranges and sorted in them; __at tells the range and the place in it. One exchange."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())


def _shifts(rows: DataFrame, size: Column) -> DataFrame:
    """__part and the sum of the sizes of all ranges before: one row a range."""
    sizes = rows.groupBy(F.shiftright("__at", ROW_BITS).alias("__part")).agg(size.alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``name``: 0, 1, 2, ... in the order given, which must have no ties.

    Rows are dealt by ranges and ranked where they are, and ranks are shifted by the sizes of the ranges before: only
    those sizes, one row a range, meet in one place.
    """
    rows = materialise(_dealt(df, order))
    place = F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    shifts = F.broadcast(_shifts(rows, F.count(F.lit(1))))  # a row a range
    return rows.withColumn("__part", F.shiftright("__at", ROW_BITS)).join(shifts, "__part").withColumn(name, (place + F.col("__shift")).cast("long")).drop("__at", "__part", "__shift")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all rows before, by the same two steps; null counts as 0."""
    rows = _dealt(df.withColumn("__value", F.coalesce(F.col(value), F.lit(0)).cast("long")), order)
    schema = StructType([*rows.schema.fields, StructField("__sum", LongType())])

    def cumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:  # of one sorted range, in its order
            values = batch.column("__value").to_numpy()
            after = np.cumsum(values) + total
            total = int(after[-1]) if len(after) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after - values, pa.int64())], names=schema.names)

    rows = materialise(rows.mapInArrow(cumulate, schema))
    shifts = F.broadcast(_shifts(rows, F.sum("__value")))
    return rows.withColumn("__part", F.shiftright("__at", ROW_BITS)).join(shifts, "__part").withColumn(name, (F.col("__sum") + F.col("__shift")).cast("long")).drop("__at", "__part", "__shift", "__sum", "__value")
