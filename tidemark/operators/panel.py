"""Feature panel: target, point-in-time features, supervised set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import transforms as tr
from .asof import asof_panel
from .grid import densify, monthly_grid

#: Target lags that the benchmark model uses; 6 and 12 are features of the panel only.
BENCHMARK_LAGS, PANEL_LAGS = (1, 2, 3), (1, 2, 3, 6, 12)


def build_target(tidy: DataFrame, series: str, smoothing: int = 3) -> DataFrame:
    """Year-on-year growth of the moving average of one series by reference month: ``date, target``."""
    w = tr.series_window("series")
    x = densify(tidy.where(F.col("series") == series).select("series", "date", "value"))
    x = x.withColumn("smooth", tr.moving_average("value", w, smoothing))
    return x.select("date", tr.yoy("smooth", w).alias("target"))


def apply_transform(rows: DataFrame, spec: str, value: str = "value", by: str = "series") -> DataFrame:
    """``rows`` with ``value`` replaced by the named transform within each series."""
    w = tr.series_window(by)
    if spec == "yoy_mma3":
        return apply_transform(apply_transform(rows, "mma3", value, by), "yoy", value, by)
    return rows.withColumn(value, tr.transform(spec)(value, w))


def diffusion_index(rows: DataFrame, value: str = "value", *, by: str = "series", date: str = "date") -> DataFrame:
    """Share of series whose value rose, among those that have a value: ``date, breadth``; NULL if none has."""
    rise = tr.difference(value, tr.series_window(by, order=date))
    up = rows.withColumn("rise", rise).groupBy(date).agg(F.sum(F.when(F.col("rise") > 0, 1).otherwise(0)).alias("up"), F.count(value).alias("known"))
    return up.select(date, F.try_divide(F.col("up"), F.col("known")).alias("breadth"))


def build_features(tidy: DataFrame, *, target_series: str, price_prefix: str = "px_", min_periods: int = 24, pair: tuple[str, str] | None = None) -> DataFrame:
    """All point-in-time features, long: ``date, feature, value``.

    One as-of join; levels get ``__yoy, __mom3, __yoy_z``, prices ``__ret1, __mom3, __mom6, __mom12``, the target series
    a point-in-time target (growth of its own moving average) and its lags, the growth rates a breadth, and ``pair`` of
    prices a relative six-month momentum and its z-score.  Everything shares the as-of join's partitioning by series.
    """
    panel = asof_panel(tidy, monthly_grid(tidy)).withColumnRenamed("asof_date", "date")
    w = tr.series_window("series")
    price = F.col("series").startswith(price_prefix)
    x = panel.select("*", tr.yoy("value", w).alias("yoy"), *[tr.mom("value", w, n).alias(f"mom{n}") for n in (1, 3, 6, 12)], tr.moving_average("value", w, 3).alias("smooth"))
    x = x.withColumn("yoy_z", tr.expanding_z("yoy", w, min_periods)).withColumn("pit", tr.yoy("smooth", w))

    x = x.select("*", *[F.lag("pit", k).over(w).alias(f"lag{k}") for k in PANEL_LAGS], tr.difference("yoy", w).alias("rise"))
    target = F.col("series") == target_series
    cells = [(~price, "yoy", "__yoy"), (F.lit(True), "mom3", "__mom3"), (~price, "yoy_z", "__yoy_z"), (price, "mom1", "__ret1"), (price, "mom6", "__mom6"), (price, "mom12", "__mom12")]
    named = [F.struct(F.when(c, F.concat("series", F.lit(name))).alias("feature"), F.col(v).alias("value")) for c, v, name in cells]
    named += [F.struct(F.when(target, F.lit(name)).alias("feature"), F.col(v).alias("value")) for name, v in {"target_pit": "pit", **{f"target_pit__lag{k}": f"lag{k}" for k in PANEL_LAGS}}.items()]
    out = x.select("date", F.inline(F.array(*named))).where("feature is not null")
    known = x.where(~price).groupBy("date").agg(F.sum(F.when(F.col("rise") > 0, 1).otherwise(0)).alias("up"), F.count("yoy").alias("n"))
    out = out.unionByName(known.select("date", F.lit("breadth").alias("feature"), F.try_divide("up", "n").alias("value")))
    if pair:
        out = out.unionByName(relative_momentum(x.select("date", "series", "mom6"), *pair, min_periods=min_periods))
    return out.withColumn("value", tr.null_if_not_finite("value"))


def cycle_factor_features(features: DataFrame, factor: DataFrame) -> DataFrame:
    """The factor (``date, factor``) and its changes over 3 and 6 rows on the panel's own months; long.

    Months without a factor have NULL, as have changes from or to such a month.
    """
    w = Window.orderBy("date")  # one factor, one row a month
    x = features.select("date").distinct().join(factor.select("date", "factor"), "date", "left")
    x = x.select("date", F.col("factor").alias("cycle_factor"), *[tr.difference("factor", w, k).alias(f"cycle_factor__chg{k}") for k in (3, 6)])
    names = ("cycle_factor", "cycle_factor__chg3", "cycle_factor__chg6")
    return x.select("date", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])))


def relative_momentum(rows: DataFrame, left: str, right: str, *, min_periods: int = 24) -> DataFrame:
    """Six-month momentum of one series minus another's, and its expanding z-score; long."""
    both = rows.where(F.col("series").isin(left, right)).groupBy("date").agg(F.max(F.when(F.col("series") == left, F.col("mom6"))).alias("l"), F.max(F.when(F.col("series") == right, F.col("mom6"))).alias("r"))
    x = both.select("date", F.lit("rel_mom6").alias("series"), (F.col("l") - F.col("r")).alias("rel"))
    x = x.withColumn("z", tr.expanding_z("rel", tr.series_window("series"), min_periods))
    pairs = F.array(F.struct(F.lit("rel_mom6").alias("feature"), F.col("rel").alias("value")), F.struct(F.lit("rel_mom6_z").alias("feature"), F.col("z").alias("value")))
    return x.select("date", F.inline(pairs))


@dataclass(frozen=True)
class Supervised:
    """Long features of the complete months, their targets, and which features carry the benchmark."""

    features: DataFrame  # date, feature, value
    target: DataFrame  # date, y
    horizon: int
    benchmark: tuple[str, ...]


def benchmark_columns() -> tuple[str, ...]:
    return ("target_pit", *[f"target_pit__lag{k}" for k in BENCHMARK_LAGS])


def lead_target(target: DataFrame, horizon: int) -> DataFrame:
    """The target ``horizon`` rows later: ``date, y``."""
    w = Window.orderBy("date")  # one series, one row a month
    return target.select("date", F.lead("target", horizon).over(w).alias("y") if horizon else F.col("target").alias("y"))


def coverage(features: DataFrame, months: DataFrame) -> DataFrame:
    """Share of the given months in which a feature has a value: ``feature, coverage``."""
    n = months.agg(F.count("*").alias("months"))
    known = features.join(months, "date", "left_semi").groupBy("feature").agg(F.count("value").alias("known"))
    return known.join(F.broadcast(n), how="cross").select("feature", F.try_divide(F.col("known"), F.col("months")).alias("coverage"))


def complete_cases(wide: DataFrame, columns: list[str]) -> DataFrame:
    cond: Column = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return wide.where(cond)


def make_supervised(features: DataFrame, target: DataFrame, horizon: int, *, min_coverage: float = 0.10) -> Supervised:
    """Features known in at least ``min_coverage`` of the months with a target, in months that also have the benchmark."""
    y = lead_target(target, horizon).where("y is not null")
    bench = benchmark_columns()
    enough = coverage(features, y).where((F.col("coverage") >= min_coverage) | F.col("feature").isin(*bench)).select("feature")
    unused = [f"target_pit__lag{k}" for k in PANEL_LAGS if k not in BENCHMARK_LAGS]
    kept = features.where(~F.col("feature").isin(*unused)).join(enough, "feature", "left_semi")
    full = kept.where(F.col("feature").isin(*bench) & F.col("value").isNotNull()).groupBy("date").count().where(F.col("count") == len(bench)).select("date")
    y = y.join(full, "date", "left_semi")
    return Supervised(kept.join(y.select("date"), "date", "left_semi"), y, horizon, bench)
