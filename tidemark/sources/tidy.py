"""The tidy table that every loader returns, and its loaders.

``date`` is the month-end of the reference month, ``published`` the time from which the value may be known.  Numbers
that can't be read become NULL and go; nothing is ever guessed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "date date, series string, value double, published timestamp_ntz"


def tidy(df: DataFrame, *, date: Column, series: Column, value: Column, published: Column) -> DataFrame:
    """Project any frame to the tidy schema, month-end stamped; NULL dates and values go."""
    out = df.select(F.last_day(date).alias("date"), series.cast("string").alias("series"), value.cast("double").alias("value"), published.cast("timestamp_ntz").alias("published"))
    return out.where("date is not null and value is not null")


def after(date: Column, days: int) -> Column:
    """Publication a fixed number of days after the month-end."""
    return F.date_add(F.last_day(date), days)


def union(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    if not parts:
        raise ValueError("no source has data")
    return reduce(DataFrame.unionByName, parts)


def best_effort(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """Union of what could be loaded, and the reason for each loader that failed or was empty."""
    parts, failed = [], {}
    for name, load in loaders.items():
        try:
            df = load()
            if df.isEmpty():
                failed[name] = "empty"
            else:
                parts.append(df.select("date", "series", "value", "published"))
        except Exception as x:  # one source must not take the others down
            failed[name] = f"{type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}"
    return (union(parts) if parts else spark.createDataFrame([], SCHEMA)), failed


# Billings workbook: a grid with year markers, region rows and twelve months.


def region_name(label: Column) -> Column:
    """Normal name of a region label, NULL for labels that are none; the first rule that fits decides."""
    text = F.lower(F.trim(label))
    return (
        F.when(label.isNull() | (text == "") | text.rlike("^[0-9]"), None)
        .when(text.contains("world") | text.isin("total", "ww"), F.lit("worldwide"))
        .when(text.contains("americas") | (text == "us"), F.lit("americas"))
        .when(text.contains("europe"), F.lit("europe"))
        .when(text.contains("japan"), F.lit("japan"))
        .when(text.contains("asia") | text.contains("pacific"), F.lit("asia_pacific"))
    )


def grid_to_long(grid: DataFrame) -> DataFrame:
    """``date, region, value`` of a grid ``row_id, label, m1 .. m12`` (strings).

    A row whose label is a year from 1980 to 2100 holds for the rows below it.  Values come in thousands.
    """
    year = F.expr("try_cast(try_cast(label as double) as int)")
    marked = grid.withColumn("mark", F.when((year >= 1980) & (year <= 2100), year))
    below = F.last("mark", ignorenulls=True).over(Window.orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))  # one sheet
    rows = marked.withColumn("year", below).where("mark is null and year is not null").withColumn("region", region_name(F.col("label"))).where("region is not null")
    cells = F.array(*[F.struct(F.lit(m).alias("month"), F.expr(f"try_cast(m{m} as double)").alias("cell")) for m in range(1, 13)])
    long = rows.select("region", "year", F.inline(cells)).where("cell is not null")
    return long.select(F.last_day(F.make_date("year", "month", F.lit(1))).alias("date"), "region", (F.col("cell") / 1000).alias("value")).orderBy("region", "date")


def load_billings(actual: DataFrame, smoothed: DataFrame | None = None, *, through: str | None = None, lag_days: int = 35) -> DataFrame:
    """Tidy billings of a workbook's sheets; values after ``through`` are forecasts and go."""
    parts = [grid_to_long(actual).withColumn("suffix", F.lit(""))]
    if smoothed is not None:
        parts.append(grid_to_long(smoothed).withColumn("suffix", F.lit("_3mma")))
    x = union(parts)
    if through is not None:
        x = x.where(F.col("date") <= F.last_day(F.lit(through).cast("date")))
    return tidy(x, date=F.col("date"), series=F.concat(F.lit("wsts_"), "region", "suffix"), value=F.col("value"), published=after(F.col("date"), lag_days))


def implausible_moves(series: DataFrame, *, alarm: float = 4.0) -> DataFrame:
    """Month-on-month log moves with |z| over ``alarm``, z by median and MAD of the first nine tenths: a warning only.

    ``series, date, move, z``; nothing is removed from the data.
    """
    w = Window.partitionBy("series").orderBy("date")
    x = series.where("value > 0").withColumn("move", F.log("value") - F.log(F.lag("value").over(w))).where("move is not null")
    x = x.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("series")))
    base = x.where("pos <= cast(floor(0.9 * n) as int)")
    mid = base.groupBy("series").agg(F.expr("percentile(move, 0.5)").alias("mid"))
    mad = base.join(mid, "series").groupBy("series").agg(F.first("mid").alias("mid"), F.expr("1.4826 * percentile(abs(move - mid), 0.5)").alias("mad"))
    z = F.try_divide(F.col("move") - F.col("mid"), F.nullif(F.col("mad"), F.lit(0.0)))
    return x.join(mad, "series").select("series", "date", "move", z.alias("z")).where(F.abs("z") > alarm)


# Company revenue by JSON.

RESPONSE = "status int, data array<struct<revenue_year: int, revenue_month: int, revenue: double, create_time: string>>"


def load_company(responses: DataFrame, company: str, *, lag_days: int = 11) -> DataFrame:
    """Tidy revenue of one company from rows ``body`` (JSON); another status or no data gives no rows.

    Published at ``create_time``, or ``lag_days`` after the month where that is missing or unreadable.
    """
    x = responses.select(F.from_json("body", RESPONSE).alias("r")).where("r.status = 200").select(F.explode("r.data").alias("d")).select("d.*")
    date = F.last_day(F.make_date("revenue_year", "revenue_month", F.lit(1)))
    published = F.coalesce(F.expr("try_to_timestamp(create_time)").cast("timestamp_ntz"), after(date, lag_days).cast("timestamp_ntz"))
    return tidy(x, date=date, series=F.lit(f"twrev_{company}"), value=F.col("revenue"), published=published)


def core_aggregate(companies: DataFrame, core: Sequence[str] | None = None, *, name: str = "twrev_aggregate", lag_days: int = 11) -> DataFrame:
    """Sum over the core series in months that all core series with any data report; no core means all series."""
    x = companies if not core else companies.where(F.col("series").isin(*core))
    n = x.agg(F.countDistinct("series").alias("n"))
    total = x.groupBy("date").agg(F.sum("value").alias("value"), F.countDistinct("series").alias("has")).join(F.broadcast(n), F.col("has") == F.col("n"))
    return tidy(total, date=F.col("date"), series=F.lit(name), value=F.col("value"), published=after(F.col("date"), lag_days))


# CSV series and prices.


def load_csv_series(spark: SparkSession, path: str, name: str, *, lag_days: int = 0) -> DataFrame:
    """Tidy series of the first two columns of a CSV file, whatever they are called; '.' and other text is missing."""
    x = spark.read.csv(path, header=True, inferSchema=False)
    day, value = x.columns[:2]
    return tidy(x, date=F.expr(f"try_cast(`{day}` as date)"), series=F.lit(f"fred_{name}"), value=F.expr(f"try_cast(`{value}` as double)"), published=after(F.expr(f"try_cast(`{day}` as date)"), lag_days))


def load_prices(daily: DataFrame) -> DataFrame:
    """Tidy month-end prices of a wide daily table ``date, <ticker>...``: the last price of each month that is known.

    A running month is stamped with its end, as if it were over.
    """
    tickers = [c for c in daily.columns if c != "date"]
    pairs = F.array(*[F.struct(F.lit(t).alias("ticker"), F.col(f"`{t}`").cast("double").alias("close")) for t in tickers])
    long = daily.select("date", F.inline(pairs)).where("close is not null")
    month = long.groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("value"))
    return tidy(month, date=F.col("month"), series=F.concat(F.lit("px_"), F.regexp_replace("ticker", r"^\^", "")), value=F.col("value"), published=F.col("month"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Tidy month-end prices of a CSV file of daily closes, the day in its first column and one ticker in each other."""
    x = spark.read.csv(path, header=True, inferSchema=False)
    day, *tickers = x.columns
    closes = [F.expr(f"try_cast(`{t}` as double)").alias(t) for t in tickers]
    return load_prices(x.select(F.expr(f"try_cast(`{day}` as date)").alias("date"), *closes).where("date is not null"))
