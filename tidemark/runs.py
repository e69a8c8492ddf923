"""The runs from tidy data to a report, each from and to a folder of Parquet and text.

``python -m tidemark.runs {features,nowcast,rescore,backtest,realtime,report} TIDY OUT --target SERIES --asset SERIES``
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .operators import asof, dating, evaluate, factor, grid, models, panel, robustness, strategy


@dataclass(frozen=True)
class Config:
    target: str
    asset: str
    horizons: tuple[int, ...] = (0, 3, 6)
    inputs: dict[str, str] = field(default_factory=dict)  # series -> transform of the factor's inputs
    reference: str = ""
    cost_bps: float = 10.0
    min_train: int = 96
    level_weights: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)
    momentum_weights: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)
    rules: dating.Rules = dating.Rules()


def _csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, numbers rounded to four places."""
    kinds = dict(df.dtypes)
    df.select(*[F.round(c, 4).alias(c) if kinds[c] == "double" else c for c in df.columns]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def features(tidy: DataFrame, out: str, cfg: Config) -> DataFrame:
    """The panel with the factor as it was known at the time, and the target.  A factor that can't be fitted is left out."""
    rows = panel.build_features(tidy, target_series=cfg.target)
    try:
        rows = rows.unionByName(panel.cycle_factor_features(rows, _factor(tidy, cfg, "filtered")))
        rows.write.mode("overwrite").parquet(f"{out}/features")
    except Exception as x:  # the factor is one source of features among others
        print(f"no factor in the panel: {type(x).__name__}: {x}")
        panel.build_features(tidy, target_series=cfg.target).write.mode("overwrite").parquet(f"{out}/features")
    panel.build_target(tidy, cfg.target).write.mode("overwrite").parquet(f"{out}/target")
    return tidy.sparkSession.read.parquet(f"{out}/features")


def nowcast(spark: SparkSession, out: str, cfg: Config) -> dict[int, DataFrame]:
    """Out-of-sample predictions, scoreboard and, of the trees, the features that they gain from, for every horizon."""
    long, target, boards = spark.read.parquet(f"{out}/features"), spark.read.parquet(f"{out}/target"), {}
    for h in cfg.horizons:
        s = panel.make_supervised(long, target, h)
        names = [r[0] for r in s.features.select("feature").distinct().orderBy("feature").collect()]
        wide = asof.wide(s.features, names, index="date", name="feature").join(s.target, "date")
        evaluate.walk_forward(wide, models.registry(s.benchmark), horizon=h, min_train=cfg.min_train).write.mode("overwrite").parquet(f"{out}/oos_h{h}")
        _csv(evaluate.importance(models.tree_gains(wide, rounds=60)), f"{out}/importance_h{h}")
        boards[h] = rescore(spark, out, h)
    return boards


def rescore(spark: SparkSession, out: str, h: int) -> DataFrame:
    """The scoreboard of stored predictions, which are not made again."""
    oos = spark.read.parquet(f"{out}/oos_h{h}")
    _csv(oos.orderBy("date"), f"{out}/nowcast_oos_h{h}")
    board = evaluate.scoreboard(oos)
    _csv(board, f"{out}/scoreboard_h{h}")
    return board


def _factor(tidy: DataFrame, cfg: Config, how: str = "smoothed") -> DataFrame:
    """``date, factor``: smoothed over everything, filtered with fixed parameters, or fitted anew each month (recursive)."""
    inputs = cfg.inputs or {cfg.target: "yoy"}
    parts = [panel.apply_transform(grid.densify(tidy.where(F.col("series") == s).select("series", "date", "value")), spec) for s, spec in inputs.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("value is not null")
    reference = cfg.reference or next(iter(inputs))
    fit = factor.cycle_factor_recursive(rows, reference=reference) if how == "recursive" else factor.cycle_factor(rows, reference=reference, filtered=how == "filtered")
    return fit.select("date", "factor").where("factor is not null")


def _returns(tidy: DataFrame, cfg: Config) -> DataFrame:
    price = grid.densify(tidy.where(F.col("series") == cfg.asset).select("series", "date", "value"))
    return strategy.monthly_returns(price).select("date", "ret")


def backtest(tidy: DataFrame, out: str, cfg: Config) -> None:
    """All configurations in one plan; measures, overfitting, phases and attribution of the first."""
    spark = tidy.sparkSession
    configs = strategy.config_grid(spark, level_weight=cfg.level_weights, momentum_weight=cfg.momentum_weights)
    cycle = _factor(tidy, cfg)
    weights = strategy.timing_weight(strategy.cycle_signal(cycle, configs.select("cfg_pos", "level_weight", "momentum_weight"))).where("weight is not null")
    returns, name = _returns(tidy, cfg), "backtest"
    strategy.run_backtest(weights, returns, cost_bps=cfg.cost_bps).write.mode("overwrite").parquet(f"{out}/{name}")
    bt = spark.read.parquet(f"{out}/{name}").withColumn("ret", F.col("strategy_ret"))
    strategy.perf_stats(bt).write.mode("overwrite").parquet(f"{out}/{name}_stats")
    robustness.overfitting(bt.select("date", "cfg_pos", "ret")).write.mode("overwrite").parquet(f"{out}/{name}_overfitting")
    _, phases, spans = dating.date_cycle(cycle.select(F.lit("cycle").alias("series"), "date", F.col("factor").alias("value")), cfg.rules)
    phases.write.mode("overwrite").parquet(f"{out}/phases")
    _csv(spans, f"{out}/chronology")
    strategy.regime_attribution(bt.where("cfg_pos = 0"), phases).write.mode("overwrite").parquet(f"{out}/{name}_regimes")
    for part in ("stats", "overfitting", "regimes"):
        _csv(spark.read.parquet(f"{out}/{name}_{part}"), f"{out}/{name}_{part}_csv")


def realtime(tidy: DataFrame, out: str, cfg: Config, *, horizon: int | None = None, model: str = "pred_gbt", min_periods: int = 36) -> DataFrame:
    """Timing by the factor known at the time, by the stored forecasts, and holding, in the months that all three have.

    Needs ``features`` and ``nowcast`` to have run.  Also compares the filtered factor with one fitted anew each month.
    """
    spark = tidy.sparkSession
    h = horizon if horizon is not None else cfg.horizons[len(cfg.horizons) > 1]
    known = spark.read.parquet(f"{out}/features").where("feature = 'cycle_factor' and value is not null").select("date", F.col("value").alias("factor"))
    configs = strategy.config_grid(spark, level_weight=cfg.level_weights[:1], momentum_weight=cfg.momentum_weights[:1])
    signals = {
        "factor timing": strategy.cycle_signal(known, configs.select("cfg_pos", "level_weight", "momentum_weight"), min_periods=min_periods),
        f"nowcast timing (h={h})": strategy.nowcast_signal(spark.read.parquet(f"{out}/oos_h{h}"), model=model, min_periods=min_periods),
    }
    returns = _returns(tidy, cfg)
    runs = {n: strategy.run_backtest(strategy.timing_weight(s).where("weight is not null"), returns, cost_bps=cfg.cost_bps) for n, s in signals.items()}
    runs = {"buy & hold": strategy.run_backtest(strategy.buy_and_hold(returns), returns, cost_bps=0.0)} | runs
    strategy.on_common_dates(runs).write.mode("overwrite").parquet(f"{out}/realtime")
    stats = strategy.perf_stats(spark.read.parquet(f"{out}/realtime"), "run")
    _csv(stats, f"{out}/realtime_timing_compare")
    factor.compare_factors(known, _factor(tidy, cfg, "recursive")).write.mode("overwrite").parquet(f"{out}/realtime_factors")
    return stats


def write_report(spark: SparkSession, out: str) -> str:
    """A page from whatever the runs have left; what is missing is said to be so."""
    read = lambda n: spark.read.parquet(f"{out}/{n}") if (Path(out) / n).exists() else None
    sheet = lambda n: report.table(spark.read.csv(f"{out}/{n}", header=True, inferSchema=True)) if (Path(out) / n).exists() else ""
    phases, stats, odds, regimes, curves, live, both = (read(n) for n in ("phases", "backtest_stats", "backtest_overfitting", "backtest_regimes", "backtest", "realtime", "realtime_factors"))
    sections = {"Brief": f"<pre>{report.brief(report.facts(phases, stats.orderBy('cfg_pos'), odds))}</pre>" if phases is not None and stats is not None else ""}
    sections["Cycle"] = report.line_chart([r["value"] for r in phases.orderBy("date").collect()]) if phases is not None else ""
    sections["Chronology"] = sheet("chronology")
    sections["Strategy"] = report.stat_card(stats.orderBy("cfg_pos").first()) if stats is not None else ""
    sections["Curve and drawdown"] = report.drawdown_chart([r["strategy_cum"] for r in curves.where("cfg_pos = 0").orderBy("date").collect()]) if curves is not None else ""
    sections["Configurations"] = report.table(stats.orderBy("cfg_pos")) if stats is not None else ""
    sections["Robustness"] = report.table(odds) if odds is not None else ""
    sections["Phases"] = report.table(regimes.orderBy("phase")) if regimes is not None else ""
    for at in sorted(Path(out).glob("oos_h*")):
        h = at.name.removeprefix("oos_h")
        sections[f"Forecasts, horizon {h}"] = sheet(f"scoreboard_h{h}") + report.prediction_charts(spark.read.parquet(str(at))) + sheet(f"importance_h{h}")
    sections["In real time"] = sheet("realtime_timing_compare")
    if live is not None:
        sections["In real time"] += "".join(f"<h3>{n}</h3>{report.line_chart([r['cum'] for r in live.where(F.col('run') == n).orderBy('date').collect()])}" for n in ("factor timing",))
        sections["In real time"] += report.table(both) if both is not None else ""
    page = report.dashboard("Cycle and timing", sections)
    Path(out, "report.html").write_text(page)
    return page


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("run", choices=["features", "nowcast", "rescore", "backtest", "report", "realtime"])
    p.add_argument("tidy"), p.add_argument("out"), p.add_argument("--target", required=True), p.add_argument("--asset", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cfg, tidy = Config(a.target, a.asset), spark.read.parquet(a.tidy)
    if a.run == "features":
        features(tidy, a.out, cfg)
    elif a.run == "nowcast":
        nowcast(spark, a.out, cfg)
    elif a.run == "rescore":
        for h in cfg.horizons:
            rescore(spark, a.out, h)
    elif a.run == "backtest":
        backtest(tidy, a.out, cfg)
    elif a.run == "realtime":
        realtime(tidy, a.out, cfg)
    else:
        write_report(spark, a.out)


if __name__ == "__main__":
    main()
