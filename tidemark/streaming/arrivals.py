"""Publications as a stream: what is known now, and what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_known(stream: DataFrame) -> DataFrame:
    """Latest published value of each series, for update or complete mode: ``series, published, date, value``.

    The same order as the as-of join: publication, then month, then value.  The state is one row a series.
    """
    known = stream.where("published is not null and value is not null")
    best = F.max(F.struct("published", "date", "value")).alias("best")
    return known.groupBy("series").agg(best).select("series", "best.*")


def arrivals(stream: DataFrame, *, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Publications per series and window, for append mode; rows later than ``late`` behind the newest are ignored."""
    x = stream.withColumn("published", F.col("published").cast("timestamp")).where("published is not null").withWatermark("published", late)
    x = x.groupBy(F.window("published", window).alias("w"), "series").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
    return x.select("series", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "total")
