"""Joins with tables that have one row for each key, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

#: Tables of at most so many short rows are broadcast: less than a MB.
SMALL = 4_000


def frequent_keys(rows: DataFrame, on: str) -> DataFrame:
    """Values of ``on`` that hold more than a quarter of a task's equal share of ``rows``: at most four for each task."""
    there = rows.filter(F.col(on).isNotNull())
    least = max(there.count() // (4 * core.shuffle_partitions(rows.sparkSession)), 1)
    return core.stored(there.groupBy(on).agg(F.count("*").alias("rows_")).filter(F.col("rows_") > least).select(on), "hot-keys")


def looked_up(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", weight: str | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one short row for each value of ``on``.

    The frequent values' rows of ``table`` are broadcast, so their rows stay where they are. All other values are dealt by hash. Rows without a value are not dealt at all. Both
    tables should be stored ones, as they are read more than once. Frequent values are counted here, unless ``weight`` names the column of ``table`` that tells how many rows a
    value has, or they are known (``hot``).
    """
    if table.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(table), on, how)
    there = rows.filter(F.col(on).isNotNull())
    if weight is not None:
        total = table.agg(F.sum(weight)).first()[0] or 0
        hot = table.filter(F.col(weight) > max(total // (4 * core.shuffle_partitions(rows.sparkSession)), 1)).select(on)
    elif hot is None:
        hot = frequent_keys(rows, on)
    columns = [*rows.columns, *(c for c in table.columns if c != on)]
    frequent = there.join(F.broadcast(table.join(F.broadcast(hot), on, "left_semi")), on, "inner" if how == "inner" else "left").join(F.broadcast(hot), on, "left_semi")
    others = there.join(F.broadcast(hot), on, "left_anti").join(table, on, how)
    out = frequent.select(*columns).union(others.select(*columns))
    if how == "left":
        none = rows.filter(F.col(on).isNull()).select(*rows.columns, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c != on))
        out = out.union(none.select(*columns))
    return out
