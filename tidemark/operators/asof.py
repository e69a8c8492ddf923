"""As-of join: what was known at each month-end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_panel(tidy: DataFrame, grid: DataFrame, *, max_age_days: int | None = None) -> DataFrame:
    """For each series and grid date the value most recently published by then: ``asof_date, series, value``.

    Backward and inclusive: ``published <= asof_date`` at midnight.  Most recent means greatest ``published``, then
    greatest ``date``, then greatest value, so ties are settled; a month published late overrides.  Rows without a
    publication time or a value are never seen.  A value stays until the next one, unless ``max_age_days`` is given.
    Every series has a row for every grid date, NULL before its first publication.

    Observations and questions are merged and the latest observation is carried forward: one shuffle and one sort by
    series, no pair of rows is compared.  The questions are (distinct series) x (grid dates).
    """
    seen = tidy.where("published is not null and value is not null").select("series", F.col("published").cast("timestamp_ntz").alias("t"), F.lit(0).alias("ask"), "date", "value")
    series = tidy.select("series").distinct()
    asked = series.join(F.broadcast(grid.select("date")), how="cross")  # the grid: one row a month
    asked = asked.select("series", F.col("date").cast("timestamp_ntz").alias("t"), F.lit(1).alias("ask"), "date", F.lit(None).cast("double").alias("value"))
    line = Window.partitionBy("series").orderBy("t", "ask", "date", "value").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("ask") == 0, F.struct("value", "t")), ignorenulls=True).over(line)
    out = seen.unionByName(asked).withColumn("last", last).where("ask = 1")
    value = F.col("last.value")
    if max_age_days is not None:
        value = F.when(F.datediff(F.col("t").cast("date"), F.col("last.t").cast("date")) <= max_age_days, value)
    return out.select(F.col("t").cast("date").alias("asof_date"), "series", value.alias("value"))


def wide(panel: DataFrame, names: list[str], *, index: str = "asof_date", name: str = "series", value: str = "value") -> DataFrame:
    """One column for each of the given names; the list keeps the pivot from scanning the data for it."""
    return panel.groupBy(index).pivot(name, names).agg(F.avg(value))
