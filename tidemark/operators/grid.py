"""Month-end grids: making them, filling series into them, resampling to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_ends(first: Column, last: Column) -> Column:
    """Array of all month-ends from the month of ``first`` to that of ``last``."""
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    return F.transform(months, lambda d: F.last_day(d))


def monthly_grid(rows: DataFrame, date: str = "date") -> DataFrame:
    """One row ``date`` for each month-end between the smallest and the largest date; none for no rows."""
    ends = rows.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a is not null")
    return ends.select(F.explode(month_ends(F.col("a"), F.col("b"))).alias("date"))


def densify(rows: DataFrame, by: str = "series") -> DataFrame:
    """Rows of each series at all its month-ends, first to last; other columns are NULL where there was no row."""
    span = rows.groupBy(by).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = span.select(by, F.explode(month_ends(F.col("a"), F.col("b"))).alias("date"))
    return grid.join(rows, [by, "date"], "left")


def month_end_last(rows: DataFrame, time: str, value: str, *by: str) -> DataFrame:
    """The last value of each month that is not NULL: rows ``*by, date, value``.

    Of several values at the latest time the largest is taken, so the result does not depend on row order.
    """
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*by, F.last_day(time).alias("date")).agg(F.max_by(value, F.struct(F.col(time), F.col(value))).alias("value"))
