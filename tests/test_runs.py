import datetime as dt

import numpy as np
from test_transforms import months

from tidemark import runs
from tidemark.sources.tidy import SCHEMA


def test_from_tidy_to_report(spark, tmp_path):
    g = np.random.default_rng(0)
    level = np.exp(np.cumsum(0.01 + 0.03 * np.sin(np.arange(300) / 8)) + 0.02 * g.normal(size=300))
    price = np.exp(np.cumsum(g.normal(0.01, 0.05, 300)))
    rows = [(d, s, float(v[i]), dt.datetime.combine(d + dt.timedelta(lag), dt.time())) for s, v, lag in (("rev", level, 35), ("agg", level * 2, 11), ("px_A", price, 0)) for i, d in enumerate(months(300, 2000))]
    tidy, out = spark.createDataFrame(rows, SCHEMA), str(tmp_path)
    cfg = runs.Config("rev", "px_A", horizons=(3,), min_train=230, level_weights=(0.5, 1.0), momentum_weights=(0.5, 1.0))
    assert "not available" in runs.write_report(spark, out)
    runs.features(tidy, out, cfg)
    board = runs.nowcast(spark, out, cfg)[3].collect()
    assert {r["model"] for r in board} == {"ar_benchmark", "elasticnet", "gbt"} and all(np.isfinite(r["MAE"]) for r in board)
    runs.backtest(tidy, out, cfg)
    assert spark.read.parquet(f"{out}/features").where("feature = 'cycle_factor__chg6' and value is not null").count() > 200
    live = {r["run"]: r for r in runs.realtime(tidy, out, cfg, min_periods=12).collect()}
    assert set(live) == {"buy & hold", "factor timing", "nowcast timing (h=3)"} and len({r["months"] for r in live.values()}) == 1
    assert spark.read.parquet(f"{out}/realtime_factors").first()["corr"] > 0.8
    again = {r["model"]: r["MAE"] for r in runs.rescore(spark, out, 3).collect()}
    assert again == {r["model"]: r["MAE"] for r in board}
    stored = spark.read.csv(f"{out}/scoreboard_h3", header=True, inferSchema=True).collect()
    assert {r["model"]: r["MAE"] for r in stored} == {m: round(v, 4) for m, v in again.items()}
    page = runs.write_report(spark, out)
    assert all(f"<h2>{x}</h2>" in page for x in ("Chronology", "Strategy", "Curve and drawdown", "Forecasts, horizon 3", "In real time"))
    assert "Sharpe" in page and "http" not in page and spark.read.parquet(f"{out}/backtest").select("cfg_pos").distinct().count() == 4
