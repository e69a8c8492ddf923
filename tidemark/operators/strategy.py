"""Timing weights, cost-aware backtests, performance: all partitioned by configuration."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms as tr

PERIODS = 12


def monthly_returns(prices: DataFrame, by: str = "series") -> DataFrame:
    """``by, date, ret`` from month-end prices."""
    return prices.select(by, "date", tr.mom("value", tr.series_window(by), 1).alias("ret"))


def config_grid(spark: SparkSession, **choices: Sequence[float]) -> DataFrame:
    """Every combination of the choices, one row each, numbered: ``cfg_pos, cfg, *names``."""
    names = list(choices)
    rows = [(i, "_".join(f"{n}={v:g}" for n, v in zip(names, c, strict=True)), *map(float, c)) for i, c in enumerate(product(*choices.values()))]
    return spark.createDataFrame(rows, "cfg_pos int, cfg string, " + ", ".join(f"{n} double" for n in names))


def cycle_signal(factor: DataFrame, configs: DataFrame, *, min_periods: int = 36) -> DataFrame:
    """Weighted sum of the z-scores of a factor and of its six-month change: ``cfg_pos, date, signal``.

    ``factor`` is ``date, factor``; ``configs`` has ``cfg_pos, level_weight, momentum_weight``.  The z-scores do not
    depend on the configuration, so they are computed once.
    """
    w = Window.orderBy("date")  # one factor, one row a month
    z = factor.select("date", "factor", tr.difference("factor", w, 6).alias("change"))
    z = z.select("date", tr.expanding_z("factor", w, min_periods).alias("zl"), tr.expanding_z("change", w, min_periods).alias("zm"))
    signal = F.col("level_weight") * F.col("zl") + F.col("momentum_weight") * F.col("zm")
    return z.join(F.broadcast(configs), how="cross").select("cfg_pos", "date", signal.alias("signal"))


def nowcast_signal(oos: DataFrame, *, model: str, min_periods: int = 36) -> DataFrame:
    """Each out-of-sample prediction against all before it, as a z-score: ``cfg_pos, date, signal`` (one configuration, 0)."""
    w = Window.orderBy("date")  # one row a month
    return oos.select(F.lit(0).alias("cfg_pos"), "date", tr.expanding_z(model, w, min_periods).alias("signal"))


def timing_weight(signal: DataFrame, *, base: float = 0.75, gain: float = 0.25, low: float = 0.0, high: float = 1.25) -> DataFrame:
    """``weight`` = base + gain * signal within bounds; NULL without a signal."""
    return signal.withColumn("weight", tr.clip(F.lit(base) + F.lit(gain) * F.col("signal"), low, high)).drop("signal")


def restrict_weights(weights: DataFrame, start: str, end: str) -> DataFrame:
    """Known weights from ``start`` to ``end``, both included; the warm-up happened on everything before."""
    return weights.withColumn("weight", tr.null_if_not_finite("weight")).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).na.drop(subset=["weight"])


def fill_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights on all months of either table within the weights' own range, carried forward: ``cfg_pos, date, weight, ret``."""
    span = weights.groupBy("cfg_pos").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    months = returns.select("date").union(weights.select("date")).distinct()
    grid = span.join(months, F.col("date").between(F.col("a"), F.col("b"))).select("cfg_pos", "date")
    both = grid.join(weights, ["cfg_pos", "date"], "left").join(returns.select("date", "ret"), "date", "left")
    return both.select("cfg_pos", "date", tr.forward_fill("weight", tr.series_window("cfg_pos")).alias("weight"), "ret")


def run_backtest(weights: DataFrame, returns: DataFrame, *, cost_bps: float = 10.0, benchmark: DataFrame | None = None) -> DataFrame:
    """One row per (cfg_pos, month) with held weight, returns, cost, turnover and curves.

    The weight decided at the end of a month earns the next month's return; trading from the weight before costs
    ``cost_bps`` hundredths of a percent of the change.  The first two months have no net return and drop out, as do
    months without an asset return; curves start at 1 + r of the first month left.
    """
    w = tr.series_window("cfg_pos")
    x = fill_weights(weights, returns)
    x = x.withColumn("held", F.lag("weight").over(w)).withColumn("turnover", F.abs(F.lag("weight").over(w) - F.lag("weight", 2).over(w)))
    x = x.withColumn("gross_ret", F.col("held") * F.col("ret")).withColumn("cost", F.col("turnover") * F.lit(cost_bps / 1e4))
    x = x.withColumn("strategy_ret", F.col("gross_ret") - F.col("cost")).where("strategy_ret is not null and ret is not null")
    x = x.select("cfg_pos", "date", F.col("held").alias("weight"), F.col("ret").alias("asset_ret"), "gross_ret", "cost", "strategy_ret", "turnover")
    x = x.withColumn("strategy_cum", tr.cumulative_growth("strategy_ret", w)).withColumn("asset_cum", tr.cumulative_growth("asset_ret", w))
    if benchmark is not None:
        x = x.join(benchmark.select("date", F.col("ret").alias("benchmark_ret")), "date", "left")
        x = x.withColumn("benchmark_cum", tr.cumulative_growth(F.coalesce("benchmark_ret", F.lit(0.0)), w))
    return x


def perf_stats(returns: DataFrame, by: str = "cfg_pos", *, ret: str = "ret", periods: int = PERIODS) -> DataFrame:
    """Ten measures of each return series: one pass for the curve, one grouped aggregate.

    Geometric annual return, annual volatility, Sharpe, Sortino (deviation of the negative returns alone), largest
    drawdown of the curve from its first month on, Calmar, hit rate, skewness, and kurtosis with 3 for a normal.
    """
    w = tr.series_window(by)
    x = returns.where(F.col(ret).isNotNull()).select(by, "date", F.col(ret).alias("r"))
    x = x.withColumn("cum", tr.cumulative_growth("r", w)).withColumn("dd", tr.drawdown("cum", w))
    root = F.lit(float(periods)) ** 0.5
    a = x.groupBy(by).agg(
        F.count("r").alias("months"), F.product(1 + F.col("r")).alias("growth"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"),
        F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.min("dd").alias("max_drawdown"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurtosis"),
    )
    a = a.withColumn("ann_return", F.when(F.col("growth") > 0, F.pow("growth", F.lit(float(periods)) / F.col("months")) - 1))
    safe = lambda x: F.nullif(x, F.lit(0.0))
    return a.select(
        by, "months", "ann_return", (F.col("sd") * root).alias("ann_vol"), F.coalesce(F.try_divide("m", safe(F.col("sd"))) * root, F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.try_divide("m", safe(F.col("down"))) * root, F.lit(0.0)).alias("sortino"), "max_drawdown",
        F.coalesce(F.try_divide("ann_return", safe(F.abs("max_drawdown"))), F.lit(0.0)).alias("calmar"), "hit_rate", "skew", "kurtosis",
    )


def regime_attribution(returns: DataFrame, phases: DataFrame, *, ret: str = "ret", periods: int = PERIODS) -> DataFrame:
    """Returns by the phase of their month: ``phase, months, mean, hit_rate, ann_vol, ann_return`` (mean compounded)."""
    x = returns.join(phases.select("date", "phase"), "date").where(F.col("phase").isNotNull() & F.col(ret).isNotNull())
    a = x.groupBy("phase").agg(F.count(ret).alias("months"), F.avg(ret).alias("mean"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), (F.stddev_samp(ret) * F.lit(float(periods)) ** 0.5).alias("ann_vol"))
    return a.withColumn("ann_return", F.pow(1 + F.col("mean"), F.lit(float(periods))) - 1)


def common_dates(*runs: DataFrame) -> DataFrame:
    """Dates that all runs have."""
    out = runs[0].select("date")
    for r in runs[1:]:
        out = out.intersect(r.select("date"))
    return out


def buy_and_hold(returns: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A weight of 1 in every month that has a return: ``cfg_pos, date, weight``."""
    w = returns.where("ret is not null").select(F.lit(0).alias("cfg_pos"), "date", F.lit(1.0).alias("weight"))
    return w if start is None else restrict_weights(w, start, end or "9999-12-31")


def on_common_dates(runs: dict[str, DataFrame], ret: str = "strategy_ret") -> DataFrame:
    """The returns of several runs in the months that all of them have: ``run, date, ret, cum``."""
    rows = [r.where(F.col(ret).isNotNull()).select(F.lit(n).alias("run"), "date", F.col(ret).alias("ret")) for n, r in runs.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    # One row a month and run, so that counting says which months are complete; the runs are read once.
    full = every.withColumn("runs", F.count("*").over(Window.partitionBy("date"))).where(F.col("runs") == len(rows)).drop("runs")
    return full.withColumn("cum", tr.cumulative_growth("ret", tr.series_window("run")))


def activity(backtest: DataFrame, *, periods: int = PERIODS) -> DataFrame:
    """Annual turnover and share of months invested: ``cfg_pos, annual_turnover, time_invested``."""
    return backtest.groupBy("cfg_pos").agg((F.sum("turnover") * periods / F.count("*")).alias("annual_turnover"), F.avg((F.col("weight") > 0).cast("double")).alias("time_invested"))
