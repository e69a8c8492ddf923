"""The tables that the registered queries start from, made of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms as tr
from ..operators import panel
from ..operators.grid import densify


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, name: str | None = None) -> Column:
    """Rounded for comparison: sums and deviations differ between engines in the last bits."""
    name = name or (x if isinstance(x, str) else None)
    return F.round(x, 6).alias(name)


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy monthly revenue by region: summed exactly, published 5 to 45 days after the month."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("v"))
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.last_day(F.col("o_orderdate").cast("date")).alias("date"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("rev_"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))).alias("series"))
    place = customer.join(F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    # Lines are added up by order before anything else is joined to them.
    by_order = item.groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    x = by_order.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(place, F.col("o_custkey") == F.col("c_custkey"))
    x = x.groupBy("date", "series", "r_regionkey").agg(F.sum("v").cast("double").alias("value"))
    return x.select("date", "series", "value", F.date_add("date", 5 + 10 * F.col("r_regionkey")).cast("timestamp_ntz").alias("published"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy monthly mean order price by priority, published at the month-end."""
    x = read(spark, sf_dir, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("date"), "o_orderpriority")
    x = x.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("value"))
    name = F.concat(F.lit("px_"), F.lower(F.substring("o_orderpriority", 1, 1)))
    return x.select("date", name.alias("series"), "value", F.col("date").cast("timestamp_ntz").alias("published"))


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series ``rev_total`` of all regions' revenue, published when the slowest region is."""
    x = revenue(spark, sf_dir).groupBy("date").agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"))
    return x.select("date", F.lit("rev_total").alias("series"), "value", F.date_add("date", 45).cast("timestamp_ntz").alias("published"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.build_target(total(spark, sf_dir), "rev_total")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(revenue(spark, sf_dir).select("series", "date", "value"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns of the price series, numbered as configurations: ``cfg_pos, series, date, ret``."""
    x = densify(prices(spark, sf_dir).select("series", "date", "value"))
    x = x.select("series", "date", tr.mom("value", tr.series_window("series")).alias("ret")).where("ret is not null")
    return x.select(F.substring("series", 4, 1).cast("int").alias("cfg_pos"), "series", "date", "ret")


# The same in SQL; every oracle begins with these.
SQL = """
WITH RECURSIVE tidy AS (
  SELECT last_day(CAST(o_orderdate AS DATE)) AS date, 'rev_' || lower(replace(r_name, ' ', '_')) AS series,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS value,
         last_day(CAST(o_orderdate AS DATE)) + CAST(5 + 10 * r_regionkey AS INTEGER) AS published
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY last_day(CAST(o_orderdate AS DATE)), r_name, r_regionkey),
grid AS (SELECT last_day(CAST(d AS DATE)) AS date FROM (SELECT unnest(generate_series(CAST(date_trunc('month', min(date)) AS TIMESTAMP),
         CAST(date_trunc('month', max(date)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM tidy)),
dense AS (SELECT s.series, g.date, t.value FROM (SELECT series, min(date) AS a, max(date) AS b FROM tidy GROUP BY series) s
         JOIN grid g ON g.date BETWEEN s.a AND s.b LEFT JOIN tidy t ON t.series = s.series AND t.date = g.date),
asof_ AS (SELECT g.date AS asof_date, s.series, t.value FROM grid g CROSS JOIN (SELECT DISTINCT series FROM tidy) s
         ASOF LEFT JOIN tidy t ON t.series = s.series AND t.published <= g.date),
prices AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, 'px_' || substr(o_orderpriority, 1, 1) AS series,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY 1, 2),
pgrid AS (SELECT s.series, g.date, p.value FROM (SELECT series, min(date) AS a, max(date) AS b FROM prices GROUP BY series) s
         JOIN grid g ON g.date BETWEEN s.a AND s.b LEFT JOIN prices p ON p.series = s.series AND p.date = g.date),
rets AS (SELECT * FROM (SELECT CAST(substr(series, 4, 1) AS INTEGER) AS cfg_pos, series, date,
         value / nullif(lag(value) OVER (PARTITION BY series ORDER BY date), 0) - 1 AS ret FROM pgrid) WHERE ret IS NOT NULL),
total AS (SELECT date, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value FROM tidy GROUP BY date),
smooth AS (SELECT g.date, t.value, CASE WHEN count(t.value) OVER w = 3 THEN avg(t.value) OVER w END AS m
         FROM grid g LEFT JOIN total t ON t.date = g.date WINDOW w AS (ORDER BY g.date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
target AS (SELECT date, m / nullif(lag(m, 12) OVER (ORDER BY date), 0) - 1 AS target FROM smooth)
"""
