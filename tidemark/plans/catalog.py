"""Registered queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms as tr
from ..operators import asof, dating, evaluate, factor, grid, models, panel, robustness, strategy
from ..sources import store, tidy
from . import base
from .base import SQL, r6, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, *, plain: bool = False):
    """Register a query under its function's name, with its oracle (after the shared tables unless ``plain``)."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql if plain else SQL + sql
        return fn

    return register


_W = "OVER (PARTITION BY series ORDER BY date)"


def _w():
    return tr.series_window("series")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["asof_growth_z"](spark, sf_dir)


# Sources, grid, as-of join


@_query("SELECT date, series, round(value, 6) AS value, published FROM tidy")
def tidy_monthly_revenue(spark, d):
    return base.revenue(spark, d).select("date", "series", r6("value"), F.col("published").cast("date").alias("published"))


@_query("SELECT date FROM grid")
def monthly_grid(spark, d):
    return grid.monthly_grid(base.revenue(spark, d))


@_query("SELECT asof_date, series, round(value, 6) AS value FROM asof_")
def asof_panel(spark, d):
    x = base.revenue(spark, d)
    return asof.asof_panel(x, grid.monthly_grid(x)).select("asof_date", "series", r6("value"))


REGIONS = ["rev_africa", "rev_america", "rev_asia", "rev_europe", "rev_middle_east"]


@_query("SELECT asof_date, " + ", ".join(f"round(max(CASE WHEN series = '{s}' THEN value END), 6) AS {s}" for s in REGIONS) + " FROM asof_ GROUP BY asof_date")
def asof_panel_wide(spark, d):
    x = base.revenue(spark, d)
    return asof.wide(asof.asof_panel(x, grid.monthly_grid(x)), REGIONS).select("asof_date", *[r6(s) for s in REGIONS])


@_query(f"""SELECT asof_date, series, round(value, 6) AS value, round(yoy, 6) AS yoy,
  round(CASE WHEN count(yoy) OVER w >= 24 THEN (yoy - avg(yoy) OVER w) / nullif(stddev_samp(yoy) OVER w, 0) END, 6) AS z
FROM (SELECT *, value / nullif(lag(value, 12) {_W.replace("date", "asof_date")}, 0) - 1 AS yoy FROM asof_)
WINDOW w AS (PARTITION BY series ORDER BY asof_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def asof_growth_z(spark, d):
    x = base.revenue(spark, d)
    w = tr.series_window("series", order="asof_date")
    p = asof.asof_panel(x, grid.monthly_grid(x)).withColumn("yoy", tr.yoy("value", w)).withColumn("z", tr.expanding_z("yoy", w))
    return p.select("asof_date", "series", r6("value"), r6("yoy"), r6("z"))


@_query("SELECT date, series, round(value, 6) AS value FROM prices")
def resample_month_end_last(spark, d):
    return base.prices(spark, d).select("date", "series", r6("value"))


@_query("""SELECT last_day(CAST(ts AS DATE)) AS date, event_type, arg_max(value, ts) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2""", plain=True)
def month_end_event(spark, d):
    return grid.month_end_last(read(spark, d, "events"), "ts", "value", "event_type").select("date", "event_type", "value")


@_query("""SELECT last_day(day) AS date, 'px_' || event_type AS series, arg_max(v, day) AS value FROM
  (SELECT CAST(ts AS DATE) AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1, 2""", plain=True)
def melt_prices(spark, d):
    e = read(spark, d, "events").select(F.col("ts").cast("date").alias("date"), "event_type", "value")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    wide = e.groupBy("date").pivot("event_type", kinds).agg(F.max("value"))
    return tidy.load_prices(wide).select("date", "series", "value")


@_query("""SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""", plain=True)
def json_props_scan(spark, d):
    e = read(spark, d, "events").select(F.col("ts").cast("date").alias("day"), F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("day").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


@_query("""SELECT t.date, round(sum(value), 6) AS value FROM tidy t WHERE series IN ('rev_asia', 'rev_europe', 'rev_america')
GROUP BY t.date HAVING count(DISTINCT series) = 3""")
def core_aggregate(spark, d):
    x = tidy.core_aggregate(base.revenue(spark, d).select("date", "series", F.round("value", 4).alias("value")), ["rev_asia", "rev_europe", "rev_america"], name="core")
    return x.select("date", r6("value"))


@_query("""SELECT label, CASE WHEN x = '' OR regexp_matches(x, '^[0-9]') THEN NULL WHEN x LIKE '%world%' OR x IN ('total', 'ww') THEN 'worldwide'
  WHEN x LIKE '%americas%' OR x = 'us' THEN 'americas' WHEN x LIKE '%europe%' THEN 'europe' WHEN x LIKE '%japan%' THEN 'japan'
  WHEN x LIKE '%asia%' OR x LIKE '%pacific%' THEN 'asia_pacific' END AS region
FROM (SELECT label, lower(trim(label)) AS x FROM (SELECT r_name || 'S' AS label FROM region UNION ALL SELECT n_name FROM nation))""", plain=True)
def region_normaliser(spark, d):
    labels = read(spark, d, "region").select(F.concat("r_name", F.lit("S")).alias("label")).union(read(spark, d, "nation").select("n_name"))
    return labels.select("label", tidy.region_name(F.col("label")).alias("region"))


@_query("""SELECT series, date, round(move, 6) AS move, round((move - mid) / nullif(mad, 0), 6) AS z FROM
 (SELECT m.*, b.mid, 1.4826 * c.dev AS mad FROM moves m JOIN mids b USING (series) JOIN
   (SELECT series, median(abs(move - mid)) AS dev FROM moves JOIN mids USING (series) WHERE pos <= CAST(floor(0.9 * n) AS INTEGER) GROUP BY series) c USING (series))
WHERE abs((move - mid) / nullif(mad, 0)) > 1.5""".join([""", moves AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS pos, count(*) OVER (PARTITION BY series) AS n FROM
  (SELECT series, date, ln(value) - ln(lag(value) OVER (PARTITION BY series ORDER BY date)) AS move FROM tidy WHERE value > 0) WHERE move IS NOT NULL),
mids AS (SELECT series, median(move) AS mid FROM moves WHERE pos <= CAST(floor(0.9 * n) AS INTEGER) GROUP BY series)
""", ""]))
def plausibility_mad_z(spark, d):
    return tidy.implausible_moves(base.revenue(spark, d), alarm=1.5).select("series", "date", r6("move"), r6("z"))


@_query("""SELECT 'revenue' AS name, count(*) AS rows, count(DISTINCT series) AS series, min(date) AS first, max(date) AS last FROM tidy""")
def manifest(spark, d):
    return store.manifest(base.revenue(spark, d), "revenue").drop("hash")


@_query("""SELECT date, series, round(value, 6) AS value FROM tidy UNION ALL SELECT date, series, round(value, 6) FROM prices""")
def union_sources(spark, d):
    return tidy.union([base.revenue(spark, d), base.prices(spark, d)]).select("date", "series", r6("value"))


# Transforms


def _transform(name: str, spec: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return panel.apply_transform(base.dense(spark, d), spec).select("series", "date", r6("value"))

    run.__name__ = name
    _query(f"SELECT series, date, round({sql}, 6) AS value FROM dense")(run)


_transform("yoy", "yoy", f"value / nullif(lag(value, 12) {_W}, 0) - 1")
_transform("mom3", "mom3", f"value / nullif(lag(value, 3) {_W}, 0) - 1")
_transform("diff", "diff", f"value - lag(value, 1) {_W}")
_FRAME = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_transform("mma3", "mma3", f"CASE WHEN count(value) {_FRAME} = 3 THEN avg(value) {_FRAME} END")


@_query(f"""SELECT series, date, round(CASE WHEN count(y) OVER w >= 24 THEN (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) END, 6) AS z
FROM (SELECT series, date, value / nullif(lag(value, 12) {_W}, 0) - 1 AS y FROM dense)
WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def zscore_expanding(spark, d):
    x = base.dense(spark, d).withColumn("y", tr.yoy("value", _w()))
    return x.select("series", "date", r6(tr.expanding_z("y", _w()), "z"))


@_query("SELECT date, " + ", ".join(f"round(lag(target, {k}) OVER (ORDER BY date), 6) AS lag{k}" for k in panel.PANEL_LAGS) + " FROM target")
def lag_features(spark, d):
    w = Window.orderBy("date")
    return base.target(spark, d).select("date", *[r6(F.lag("target", k).over(w), f"lag{k}") for k in panel.PANEL_LAGS])


@_query("SELECT date, round(lead(target, 3) OVER (ORDER BY date), 6) AS y FROM target")
def lead_target(spark, d):
    return panel.lead_target(base.target(spark, d), 3).select("date", r6("y"))


@_query("SELECT date, round(target - lag(target, 6) OVER (ORDER BY date), 6) AS diff6 FROM target")
def diff6(spark, d):
    return base.target(spark, d).select("date", r6(tr.difference("target", Window.orderBy("date"), 6), "diff6"))


@_query("""SELECT date, round(rel, 6) AS rel, round(CASE WHEN count(rel) OVER w >= 24 THEN (rel - avg(rel) OVER w) / nullif(stddev_samp(rel) OVER w, 0) END, 6) AS z
FROM (SELECT date, max(CASE WHEN series = 'px_1' THEN m END) - max(CASE WHEN series = 'px_2' THEN m END) AS rel FROM
  (SELECT series, date, value / nullif(lag(value, 6) OVER (PARTITION BY series ORDER BY date), 0) - 1 AS m FROM pgrid WHERE series IN ('px_1', 'px_2')) GROUP BY date)
WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def relative_momentum(spark, d):
    x = grid.densify(base.prices(spark, d).select("series", "date", "value")).withColumn("mom6", tr.mom("value", _w(), 6))
    long = panel.relative_momentum(x, "px_1", "px_2")
    return long.groupBy("date").pivot("feature", ["rel_mom6", "rel_mom6_z"]).agg(F.max("value")).select("date", r6("rel_mom6", "rel"), r6("rel_mom6_z", "z"))


@_query(f"""SELECT date, round(CAST(sum(CASE WHEN rise > 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(value), 0), 6) AS breadth
FROM (SELECT date, value, value - lag(value) {_W} AS rise FROM dense) GROUP BY date""")
def diffusion_index(spark, d):
    return panel.diffusion_index(base.dense(spark, d)).select("date", r6("breadth"))


@_query("SELECT series, date, round((value - avg(value) OVER (PARTITION BY series)) / nullif(stddev_samp(value) OVER (PARTITION BY series), 0), 6) AS z FROM dense")
def standardise(spark, d):
    return base.dense(spark, d).select("series", "date", r6(tr.standardise("value", Window.partitionBy("series")), "z"))


# Panel and supervised set


@_query("SELECT date, round(target, 6) AS target FROM target")
def target_build(spark, d):
    return base.target(spark, d).select("date", r6("target"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    x = base.revenue(spark, d).unionByName(base.total(spark, d)).unionByName(base.prices(spark, d))
    # Months x features, read several times below: held in memory, recomputed if an executor goes.
    return panel.build_features(x, target_series="rev_total", pair=("px_1", "px_2"), min_periods=12).persist()


_FEATURES = f""", every AS (SELECT date, series, value, published FROM tidy UNION ALL SELECT date, 'rev_total', value, date + 45 FROM total UNION ALL SELECT date, series, value, date FROM prices),
ask AS (SELECT g.date AS asof_date, s.series, t.value FROM grid g CROSS JOIN (SELECT DISTINCT series FROM every) s
  ASOF LEFT JOIN every t ON t.series = s.series AND t.published <= g.date),
steps AS (SELECT series, asof_date AS date, value, {", ".join(f"value / nullif(lag(value, {k}) OVER o, 0) - 1 AS m{k}" for k in (1, 3, 6, 12))},
  CASE WHEN count(value) OVER t = 3 THEN avg(value) OVER t END AS s FROM ask
  WINDOW o AS (PARTITION BY series ORDER BY asof_date), t AS (PARTITION BY series ORDER BY asof_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
zs AS (SELECT *, s / nullif(lag(s, 12) OVER o, 0) - 1 AS pit, CASE WHEN count(m12) OVER e >= 12 THEN (m12 - avg(m12) OVER e) / nullif(stddev_samp(m12) OVER e, 0) END AS z,
  m12 - lag(m12) OVER o AS rise FROM steps
  WINDOW o AS (PARTITION BY series ORDER BY date), e AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rel AS (SELECT date, max(CASE WHEN series = 'px_1' THEN m6 END) - max(CASE WHEN series = 'px_2' THEN m6 END) AS r FROM steps GROUP BY date),
features AS (
  SELECT date, series || '__yoy' AS feature, m12 AS value FROM zs WHERE series LIKE 'rev%' UNION ALL SELECT date, series || '__mom3', m3 FROM zs
  UNION ALL SELECT date, series || '__yoy_z', z FROM zs WHERE series LIKE 'rev%'
  UNION ALL SELECT date, series || '__ret1', m1 FROM zs WHERE series LIKE 'px%' UNION ALL SELECT date, series || '__mom6', m6 FROM zs WHERE series LIKE 'px%'
  UNION ALL SELECT date, series || '__mom12', m12 FROM zs WHERE series LIKE 'px%' UNION ALL SELECT date, 'target_pit', pit FROM zs WHERE series = 'rev_total'
  {" ".join(f"UNION ALL SELECT date, 'target_pit__lag{k}', lag(pit, {k}) OVER (ORDER BY date) FROM zs WHERE series = 'rev_total'" for k in panel.PANEL_LAGS)}
  UNION ALL SELECT date, 'breadth', CAST(sum(CASE WHEN rise > 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(m12), 0) FROM zs WHERE series LIKE 'rev%' GROUP BY date
  UNION ALL SELECT date, 'rel_mom6', r FROM rel UNION ALL SELECT date, 'rel_mom6_z', CASE WHEN count(r) OVER e >= 12 THEN (r - avg(r) OVER e) / nullif(stddev_samp(r) OVER e, 0) END
    FROM rel WINDOW e AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ys AS (SELECT * FROM (SELECT date, lead(target, 3) OVER (ORDER BY date) AS y FROM target) WHERE y IS NOT NULL),
cover AS (SELECT feature, CAST(count(value) AS DOUBLE) / (SELECT count(*) FROM ys) AS coverage FROM features JOIN ys USING (date) GROUP BY feature),
full_ AS (SELECT date FROM features WHERE feature IN ('target_pit', 'target_pit__lag1', 'target_pit__lag2', 'target_pit__lag3') AND value IS NOT NULL GROUP BY date HAVING count(*) = 4)
"""


@_query(_FEATURES + "SELECT date, feature, round(value, 6) AS value FROM features")
def feature_panel(spark, d):
    return _features(spark, d).select("date", "feature", r6("value"))


@_query(_FEATURES + "SELECT feature, round(coverage, 6) AS coverage FROM cover WHERE coverage >= 0.5")
def coverage_pruning(spark, d):
    y = panel.lead_target(base.target(spark, d), 3).where("y is not null")
    return panel.coverage(_features(spark, d), y).where("coverage >= 0.5").select("feature", r6("coverage"))


@_query(_FEATURES + "SELECT date, round(y, 6) AS y FROM ys SEMI JOIN full_ USING (date)")
def complete_cases(spark, d):
    return panel.make_supervised(_features(spark, d), base.target(spark, d), 3).target.select("date", r6("y"))


@_query(_FEATURES + """SELECT f.date, f.feature, round(f.value, 6) AS value, round(y.y, 6) AS y FROM features f JOIN ys y USING (date) JOIN full_ USING (date) JOIN cover USING (feature)
WHERE (coverage >= 0.1 OR feature IN ('target_pit', 'target_pit__lag1', 'target_pit__lag2', 'target_pit__lag3')) AND feature NOT IN ('target_pit__lag6', 'target_pit__lag12')""")
def supervised_h3(spark, d):
    s = panel.make_supervised(_features(spark, d), base.target(spark, d), 3)
    return s.features.join(s.target, "date").select("date", "feature", r6("value"), r6("y"))


# Strategy


@_query("SELECT cfg_pos, series, date, round(ret, 6) AS ret FROM rets")
def monthly_returns(spark, d):
    return base.returns(spark, d).select("cfg_pos", "series", "date", r6("ret"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    configs = strategy.config_grid(spark, level_weight=(0.5, 1.0), momentum_weight=(0.5, 1.0))
    signal = strategy.cycle_signal(base.target(spark, d).select("date", F.col("target").alias("factor")), configs.select("cfg_pos", "level_weight", "momentum_weight"), min_periods=12)
    return strategy.timing_weight(signal)


def _asset(spark: SparkSession, d: str) -> DataFrame:
    return base.returns(spark, d).where("cfg_pos = 1").select("date", "ret")


_BACKTEST = """, cfg AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE, 0.5::DOUBLE), (1, 0.5, 1.0), (2, 1.0, 0.5), (3, 1.0, 1.0)) v(cfg_pos, lw, mw)),
change AS (SELECT date, target AS f, target - lag(target, 6) OVER (ORDER BY date) AS c FROM target),
z AS (SELECT date, CASE WHEN count(f) OVER e >= 12 THEN (f - avg(f) OVER e) / nullif(stddev_samp(f) OVER e, 0) END AS zl,
  CASE WHEN count(c) OVER e >= 12 THEN (c - avg(c) OVER e) / nullif(stddev_samp(c) OVER e, 0) END AS zm FROM change
  WINDOW e AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
signals AS (SELECT cfg_pos, date, lw * zl + mw * zm AS signal FROM z CROSS JOIN cfg),
weights AS (SELECT cfg_pos, date, CASE WHEN signal IS NOT NULL THEN greatest(least(0.75 + 0.25 * signal, 1.25), 0.0) END AS weight FROM signals),
known AS (SELECT * FROM weights WHERE weight IS NOT NULL),
asset AS (SELECT date, ret FROM rets WHERE cfg_pos = 1),
filled AS (SELECT s.cfg_pos, m.date, last_value(k.weight IGNORE NULLS) OVER (PARTITION BY s.cfg_pos ORDER BY m.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight, a.ret
  FROM (SELECT cfg_pos, min(date) AS a, max(date) AS b FROM known GROUP BY cfg_pos) s JOIN (SELECT date FROM asset UNION SELECT date FROM known) m ON m.date BETWEEN s.a AND s.b
  LEFT JOIN known k ON k.cfg_pos = s.cfg_pos AND k.date = m.date LEFT JOIN asset a ON a.date = m.date),
held AS (SELECT cfg_pos, date, ret, lag(weight) OVER w AS h, abs(lag(weight) OVER w - lag(weight, 2) OVER w) AS turnover FROM filled WINDOW w AS (PARTITION BY cfg_pos ORDER BY date)),
net AS (SELECT cfg_pos, date, h AS weight, ret AS asset_ret, h * ret AS gross_ret, turnover * 0.001 AS cost, h * ret - turnover * 0.001 AS strategy_ret, turnover
  FROM held WHERE h * ret - turnover * 0.001 IS NOT NULL AND ret IS NOT NULL),
curves AS (SELECT *, product(1 + strategy_ret) OVER w AS strategy_cum, product(1 + asset_ret) OVER w AS asset_cum FROM net
  WINDOW w AS (PARTITION BY cfg_pos ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
_BT = ("weight", "asset_ret", "gross_ret", "cost", "strategy_ret", "turnover", "strategy_cum", "asset_cum")


@_query(_BACKTEST + "SELECT cfg_pos, date, round(weight, 6) AS weight FROM weights")
def timing_weight_clip(spark, d):
    return _weights(spark, d).select("cfg_pos", "date", r6("weight"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).where("weight is not null")


@_query(_BACKTEST + "SELECT cfg_pos, date, round(weight, 6) AS weight, round(ret, 6) AS ret FROM filled")
def ffill_weights(spark, d):
    return strategy.fill_weights(_known(spark, d), _asset(spark, d)).select("cfg_pos", "date", r6("weight"), r6("ret"))


@_query(_BACKTEST + "SELECT cfg_pos, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in _BT) + " FROM curves")
def backtest_grid(spark, d):
    return strategy.run_backtest(_known(spark, d), _asset(spark, d)).select("cfg_pos", "date", *[r6(c) for c in _BT])


@_query(_BACKTEST + "SELECT date, round(strategy_ret, 6) AS strategy_ret, round(strategy_cum, 6) AS strategy_cum FROM curves WHERE cfg_pos = 0")
def backtest(spark, d):
    return strategy.run_backtest(_known(spark, d).where("cfg_pos = 0"), _asset(spark, d)).select("date", r6("strategy_ret"), r6("strategy_cum"))


@_query(_FEATURES + """, months AS (SELECT DISTINCT date FROM features), c AS (SELECT date, target AS f, target - lag(target, 3) OVER (ORDER BY date) AS c3, target - lag(target, 6) OVER (ORDER BY date) AS c6
  FROM months LEFT JOIN target USING (date))
SELECT date, 'cycle_factor' AS feature, round(f, 6) AS value FROM c UNION ALL SELECT date, 'cycle_factor__chg3', round(c3, 6) FROM c UNION ALL SELECT date, 'cycle_factor__chg6', round(c6, 6) FROM c""")
def cycle_factor_panel(spark, d):
    """The factor's features, of a factor that SQL can state too."""
    f = panel.cycle_factor_features(_features(spark, d), base.target(spark, d).select("date", F.col("target").alias("factor")))
    return f.select("date", "feature", r6("value"))


@_query(_BACKTEST + "SELECT cfg_pos, round(sum(turnover) * 12 / count(*), 6) AS annual_turnover, round(avg(CASE WHEN weight > 0 THEN 1.0 ELSE 0.0 END), 6) AS time_invested FROM net GROUP BY cfg_pos")
def activity(spark, d):
    return strategy.activity(strategy.run_backtest(_known(spark, d), _asset(spark, d))).select("cfg_pos", r6("annual_turnover"), r6("time_invested"))


@_query("SELECT series, date, round(product(1 + ret) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum FROM rets")
def cumulative_curve(spark, d):
    return base.returns(spark, d).select("series", "date", r6(tr.cumulative_growth("ret", _w()), "cum"))


_CURVE = """, curve AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM rets),
drop_ AS (SELECT *, cum / max(cum) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM curve),
mean AS (SELECT cfg_pos, avg(ret) AS m FROM rets GROUP BY cfg_pos),
moments AS (SELECT r.cfg_pos, avg(power(ret - m, 2)) AS m2, avg(power(ret - m, 3)) AS m3, avg(power(ret - m, 4)) AS m4 FROM rets r JOIN mean USING (cfg_pos) GROUP BY r.cfg_pos)
"""


@_query(_CURVE + "SELECT series, date, round(dd, 6) AS dd FROM drop_")
def drawdown(spark, d):
    x = base.returns(spark, d).withColumn("cum", tr.cumulative_growth("ret", _w()))
    return x.select("series", "date", r6(tr.drawdown("cum", _w()), "dd"))


@_query(_CURVE + """SELECT p.cfg_pos, months, round(g, 6) AS ann_return, round(sd * sqrt(12), 6) AS ann_vol, round(m / sd * sqrt(12), 6) AS sharpe, round(m / down * sqrt(12), 6) AS sortino,
  round(mdd, 6) AS max_drawdown, round(g / abs(mdd), 6) AS calmar, round(hit, 6) AS hit_rate, round(m3 / power(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2), 6) AS kurtosis
FROM (SELECT cfg_pos, count(*) AS months, power(product(1 + ret), 12.0 / count(*)) - 1 AS g, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS down,
  min(dd) AS mdd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM drop_ GROUP BY cfg_pos) p JOIN moments USING (cfg_pos)""")
def perf_stats(spark, d):
    s = strategy.perf_stats(base.returns(spark, d))
    return s.select("cfg_pos", "months", *[r6(c) for c in s.columns[2:]])


@_query("SELECT cfg_pos, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) AS sr FROM rets GROUP BY cfg_pos")
def trial_sharpes(spark, d):
    return robustness.sharpe_moments(base.returns(spark, d)).select("cfg_pos", r6("sr"))


@_query(_CURVE + """SELECT cfg_pos, t, round(sr, 6) AS sr, round(m3 / power(m2, 1.5), 6) AS g3, round(m4 / (m2 * m2), 6) AS g4
FROM (SELECT cfg_pos, count(*) AS t, avg(ret) / nullif(stddev_samp(ret), 0) AS sr FROM rets GROUP BY cfg_pos) JOIN moments USING (cfg_pos)""")
def deflated_sharpe_moments(spark, d):
    return robustness.sharpe_moments(base.returns(spark, d)).select("cfg_pos", "t", r6("sr"), r6("g3"), r6("g4"))


@_query()
def deflated_sharpe(spark, d):
    rows = robustness.sharpe_moments(base.returns(spark, d)).orderBy("cfg_pos").collect()  # one row a configuration
    all_sr = [r["sr"] for r in rows]
    out = [(r["cfg_pos"], *robustness.deflated_sharpe(r["t"], r["sr"], r["g3"], r["g4"], trials=len(rows), trial_sharpes=all_sr).values()) for r in rows]
    return spark.createDataFrame(out, "cfg_pos int, sharpe double, sharpe_annual double, expected_max double, standard_error double, dsr double")


_CSCV = """, full_ AS (SELECT date FROM rets GROUP BY date HAVING count(DISTINCT cfg_pos) = (SELECT count(DISTINCT cfg_pos) FROM rets)),
block AS (SELECT date, ntile(10) OVER (ORDER BY date) AS block FROM full_),
x AS (SELECT cfg_pos, block, ret FROM rets JOIN block USING (date))
"""


@_query(_CSCV + "SELECT cfg_pos, CAST(block AS INTEGER) AS block, count(*) AS n, round(sum(ret), 6) AS total FROM x GROUP BY cfg_pos, block")
def cscv_blocks(spark, d):
    s = robustness.block_sums(base.returns(spark, d).select("date", "cfg_pos", "ret"), 10)
    return s.select("cfg_pos", "block", "n", r6(F.col("s1") + F.col("n") * F.col("shift"), "total"))


@_query(_CSCV + """, masks AS (SELECT i FROM range(1024) t(i) WHERE bit_count(CAST(i AS INTEGER)) = 5),
sr AS (SELECT i, (i >> (block - 1)) & 1 AS side, cfg_pos, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS s FROM x CROSS JOIN masks GROUP BY 1, 2, 3),
best AS (SELECT i, cfg_pos FROM (SELECT i, cfg_pos, row_number() OVER (PARTITION BY i ORDER BY s DESC, cfg_pos) AS k FROM sr WHERE side = 1) WHERE k = 1),
ranks AS (SELECT i, cfg_pos, rank() OVER (PARTITION BY i ORDER BY s) + (count(*) OVER (PARTITION BY i, s) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY i) AS n FROM sr WHERE side = 0),
logits AS (SELECT n, ln((r / (n + 1)) / (1 - r / (n + 1))) AS l FROM ranks JOIN best USING (i, cfg_pos))
SELECT round(avg(CASE WHEN l <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, round(quantile_cont(l, 0.5), 6) AS logit_median, count(*) AS n_splits, max(n) AS n_configs FROM logits""")
def pbo(spark, d):
    p = robustness.overfitting(base.returns(spark, d).select("date", "cfg_pos", "ret"))
    return p.select(r6("pbo"), r6("logit_median"), "n_splits", "n_configs")


@_query("""SELECT phase, months, round(mean, 6) AS mean, round(hit_rate, 6) AS hit_rate, round(ann_vol, 6) AS ann_vol, round(power(1 + mean, 12) - 1, 6) AS ann_return FROM
 (SELECT CASE WHEN target >= 0 THEN 'up' ELSE 'down' END AS phase, count(*) AS months, avg(ret) AS mean, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, stddev_samp(ret) * sqrt(12) AS ann_vol
  FROM rets JOIN target USING (date) WHERE cfg_pos = 1 AND target IS NOT NULL GROUP BY 1)""")
def regime_attribution(spark, d):
    phases = base.target(spark, d).where("target is not null").select("date", F.when(F.col("target") >= 0, "up").otherwise("down").alias("phase"))
    a = strategy.regime_attribution(_asset(spark, d), phases)
    return a.select("phase", "months", *[r6(c) for c in ("mean", "hit_rate", "ann_vol", "ann_return")])


@_query("SELECT date FROM rets WHERE cfg_pos = 1 INTERSECT SELECT date FROM rets WHERE cfg_pos = 2 INTERSECT SELECT date FROM target WHERE target IS NOT NULL")
def intersect_runs(spark, d):
    r = base.returns(spark, d)
    return strategy.common_dates(r.where("cfg_pos = 1"), r.where("cfg_pos = 2"), base.target(spark, d).where("target is not null"))


@_query("SELECT date FROM rets UNION SELECT date FROM target WHERE target IS NOT NULL")
def union_index(spark, d):
    return base.returns(spark, d).select("date").union(base.target(spark, d).where("target is not null").select("date")).distinct()


# Evaluation

_LINE = """, xy AS (SELECT date, target AS x, lead(target, 3) OVER (ORDER BY date) AS y FROM target),
ok AS (SELECT date, x, y, row_number() OVER (ORDER BY date) - 1 AS pos, year(date) * 12 + month(date) AS m FROM xy WHERE x IS NOT NULL AND y IS NOT NULL),
fold AS (SELECT t.date AS test_date, count(*) AS n_train FROM ok t JOIN ok r ON t.m - r.m >= 7 AND r.pos < t.pos WHERE t.pos >= 31 GROUP BY t.date HAVING count(*) >= 24),
pred AS (SELECT t.date, any_value(t.y) AS y_true, any_value(f.n_train) AS n_train, regr_intercept(r.y, r.x) + regr_slope(r.y, r.x) * any_value(t.x) AS p
  FROM fold f JOIN ok t ON t.date = f.test_date JOIN ok r ON r.pos < f.n_train GROUP BY t.date)
"""


def _xy(spark: SparkSession, d: str) -> DataFrame:
    t = base.target(spark, d)
    return t.select("date", F.col("target").alias("x"), F.lead("target", 3).over(Window.orderBy("date")).alias("y")).where("x is not null and y is not null")


@_query(_LINE + "SELECT test_date, n_train FROM fold")
def walk_forward_train_counts(spark, d):
    return evaluate.folds(_xy(spark, d), horizon=3, min_train=24)


@_query(_LINE + "SELECT date, round(y_true, 6) AS y_true, n_train, round(p, 6) AS pred_ar FROM pred")
def ar_benchmark_oos(spark, d):
    p = evaluate.ar_benchmark_oos(_xy(spark, d), horizon=3, min_train=24)
    return p.select("date", r6("y_true"), "n_train", r6("pred_ar"))


def _nowcast(spark: SparkSession, d: str) -> DataFrame:
    oos = evaluate.ar_benchmark_oos(_xy(spark, d), horizon=3, min_train=24)
    weights = strategy.timing_weight(strategy.nowcast_signal(oos, model="pred_ar", min_periods=6)).where("weight is not null")
    return strategy.run_backtest(weights, _asset(spark, d))


# Weights from the forecasts, and of buying and holding, through the same backtest as _BACKTEST's.
_LIVE = _LINE + """, asset AS (SELECT date, ret FROM rets WHERE cfg_pos = 1),
zn AS (SELECT date, CASE WHEN count(p) OVER e >= 6 THEN (p - avg(p) OVER e) / nullif(stddev_samp(p) OVER e, 0) END AS s FROM pred WINDOW e AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cf AS (SELECT date, target AS f, target - lag(target, 6) OVER (ORDER BY date) AS c FROM target),
zf AS (SELECT date, CASE WHEN count(f) OVER e >= 12 THEN (f - avg(f) OVER e) / nullif(stddev_samp(f) OVER e, 0) END AS zl,
  CASE WHEN count(c) OVER e >= 12 THEN (c - avg(c) OVER e) / nullif(stddev_samp(c) OVER e, 0) END AS zm FROM cf WINDOW e AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
want AS (SELECT 'nowcast' AS run, date, greatest(least(0.75 + 0.25 * s, 1.25), 0.0) AS weight, 0.001::DOUBLE AS fee FROM zn WHERE s IS NOT NULL
  UNION ALL SELECT 'factor', date, greatest(least(0.75 + 0.25 * (0.5 * zl + 0.5 * zm), 1.25), 0.0), 0.001 FROM zf WHERE zl + zm IS NOT NULL
  UNION ALL SELECT 'hold', date, 1.0, 0.0 FROM asset),
span AS (SELECT run, any_value(fee) AS fee, min(date) AS a, max(date) AS b FROM want GROUP BY run),
filled AS (SELECT s.run, s.fee, m.date, last_value(k.weight IGNORE NULLS) OVER (PARTITION BY s.run ORDER BY m.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight, a.ret
  FROM span s JOIN (SELECT date FROM asset UNION SELECT date FROM want) m ON m.date BETWEEN s.a AND s.b LEFT JOIN want k ON k.run = s.run AND k.date = m.date LEFT JOIN asset a ON a.date = m.date),
held AS (SELECT run, date, ret, fee, lag(weight) OVER w AS h, abs(lag(weight) OVER w - lag(weight, 2) OVER w) AS turnover FROM filled WINDOW w AS (PARTITION BY run ORDER BY date)),
net AS (SELECT run, date, h * ret - turnover * fee AS r, h FROM held WHERE h * ret - turnover * fee IS NOT NULL),
common AS (SELECT run, date, r FROM net WHERE date IN (SELECT date FROM net GROUP BY date HAVING count(*) = 3))
"""


@_query(_LIVE + "SELECT date, round(h, 6) AS weight, round(r, 6) AS strategy_ret FROM net WHERE run = 'nowcast'")
def nowcast_timing(spark, d):
    return _nowcast(spark, d).select("date", r6("weight"), r6("strategy_ret"))


@_query(_LIVE + """, curve AS (SELECT *, product(1 + r) OVER (PARTITION BY run ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM common),
drop_ AS (SELECT *, cum / max(cum) OVER (PARTITION BY run ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM curve)
SELECT run, count(*) AS months, round(power(product(1 + r), 12.0 / count(*)) - 1, 6) AS ann_return, round(stddev_samp(r) * sqrt(12), 6) AS ann_vol, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe,
  round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM drop_ GROUP BY run""")
def realtime_compare(spark, d):
    """Timing by the factor, by the forecasts, and holding, in the months that all three have."""
    asset = _asset(spark, d)
    hold = strategy.run_backtest(strategy.buy_and_hold(asset), asset, cost_bps=0.0)
    runs = strategy.on_common_dates({"factor": strategy.run_backtest(_known(spark, d).where("cfg_pos = 0"), asset), "nowcast": _nowcast(spark, d), "hold": hold})
    s = strategy.perf_stats(runs, "run")
    return s.select("run", "months", *[r6(c) for c in ("ann_return", "ann_vol", "sharpe", "max_drawdown", "hit_rate")])


@_query(_LINE + """SELECT count(*) AS months, round(corr(a, b), 6) AS corr FROM (SELECT t.date, t.target AS a, s.m AS b FROM target t JOIN smooth s USING (date)) WHERE a IS NOT NULL AND b IS NOT NULL""")
def factor_comparison(spark, d):
    """Two estimates on their common months; here series that SQL can state."""
    x = grid.densify(base.total(spark, d).select("series", "date", "value"))
    level = x.select("date", tr.moving_average("value", tr.series_window("series"), 3).alias("factor"))
    c = factor.compare_factors(base.target(spark, d).select("date", F.col("target").alias("factor")), level)
    return c.select("months", r6("corr"))


@_query(_LINE + """, o AS (SELECT date, y_true, p AS pred_ar, 0.5 * p AS pred_half, lag(y_true) OVER (ORDER BY date) AS b FROM pred),
q AS (SELECT quantile_cont(abs(y_true - b), 0.67) AS c FROM o),
long AS (SELECT 'ar' AS model, y_true, pred_ar AS p, b FROM o UNION ALL SELECT 'half', y_true, pred_half, b FROM o),
s AS (SELECT *, abs(y_true - p) AS e, CASE WHEN sign(y_true) = sign(p) THEN 1.0 ELSE 0.0 END AS dir, CASE WHEN b IS NOT NULL THEN CASE WHEN sign(y_true - b) = sign(p - b) THEN 1.0 ELSE 0.0 END END AS side,
  abs(y_true - b) >= c AS turn FROM long CROSS JOIN q),
a AS (SELECT model, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, avg(dir) AS da, avg(side) AS ta, corr(y_true, p) AS co, avg(CASE WHEN turn THEN e END) AS mt, avg(CASE WHEN turn THEN side END) AS tt FROM s GROUP BY model)
SELECT model, round(mae, 6) AS "MAE", round(rmse, 6) AS "RMSE", round(1 - mae / (SELECT mae FROM a WHERE model = 'ar'), 6) AS "skill_vs_AR", round(da, 6) AS dir_acc, round(ta, 6) AS turn_acc,
  round(co, 6) AS corr, round(mt, 6) AS "MAE_turns", round(tt, 6) AS turn_acc_turns FROM a""")
def scoreboard(spark, d):
    p = evaluate.ar_benchmark_oos(_xy(spark, d), horizon=3, min_train=24).withColumn("pred_half", 0.5 * F.col("pred_ar"))
    s = evaluate.scoreboard(p.select("date", "y_true", "pred_ar", "pred_half"), benchmark="ar")
    return s.select("model", *[r6(c) for c in s.columns[1:]])


@_query("""SELECT round(quantile_cont(abs(d), 0.67), 6) AS cut, count(d) AS moves FROM (SELECT target - lag(target) OVER (ORDER BY date) AS d FROM target WHERE target IS NOT NULL)""")
def turn_mask_quantile(spark, d):
    x = base.target(spark, d).where("target is not null").select(F.abs(tr.difference("target", Window.orderBy("date"))).alias("m"))
    return x.agg(F.expr("round(percentile(m, 0.67), 6)").alias("cut"), F.count("m").alias("moves"))


@_query("""SELECT p_type AS feature, split_part(p_type, '_', 1) AS family, gain, round(gain / (SELECT sum(gain) FROM g), 6) AS share FROM g ORDER BY gain DESC, p_type LIMIT 20""".join(["""
WITH g AS (SELECT replace(p_type, ' ', '_') AS p_type, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gain FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
""", ""]), plain=True)
def topk_importance(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("_")).alias("feature"))
    item = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    gains = item.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("feature").agg(F.sum("v").cast("double").alias("gain"))
    return evaluate.importance(gains).select("feature", "family", "gain", r6("share"))


@_query("SELECT series, round(corr(value, target), 6) AS corr FROM dense JOIN target USING (date) GROUP BY series")
def corr_inputs(spark, d):
    x = factor.loadings(base.dense(spark, d), base.target(spark, d).select("date", F.col("target").alias("factor")))
    return x.select("series", r6("corr"))


@_query()
def elasticnet_oos(spark, d):
    return _oos(spark, d, {"elasticnet": models.elastic_net(n_alphas=40)})


@_query()
def gbt_oos(spark, d):
    return _oos(spark, d, {"gbt": models.boosted_trees(rounds=300)})


@_query()
def gbt_importance(spark, d):
    """The twenty features that the trees gain most from, with their share of all gains."""
    return evaluate.importance(models.tree_gains(_wide(spark, d)))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    s = panel.make_supervised(_features(spark, d), base.target(spark, d), 3)
    names = [r[0] for r in s.features.select("feature").distinct().orderBy("feature").collect()]  # the model's columns
    return asof.wide(s.features, names, index="date", name="feature").join(s.target, "date")


def _oos(spark: SparkSession, d: str, some: dict) -> DataFrame:
    return evaluate.walk_forward(_wide(spark, d), some, horizon=3, min_train=24)


@_query()
def factor_panel(spark, d):
    """The panel with the factor as it was known at the time."""
    f = _features(spark, d)
    return panel.cycle_factor_features(f, dfm_factor_pit(spark, d)).unionByName(f)


# Dating

_TURNS = """, s AS (SELECT 'target' AS series, date, target AS value, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS months FROM target WHERE target IS NOT NULL),
f AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo, count(*) OVER w AS n, lag(value) OVER (ORDER BY date) AS b, lead(value) OVER (ORDER BY date) AS a FROM s
  WINDOW w AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
turns AS (SELECT series, date, value, pos, months, CASE WHEN value = hi AND (value > b OR value > a) THEN 'peak' ELSE 'trough' END AS kind FROM f
  WHERE n = 5 AND ((value = hi AND (value > b OR value > a)) OR (value = lo AND (value < b OR value < a))))
"""


def _cycle(spark: SparkSession, d: str) -> DataFrame:
    return base.target(spark, d).select(F.lit("target").alias("series"), "date", F.col("target").alias("value")).where("value is not null")


@_query(_TURNS + "SELECT date, kind, round(value, 6) AS value FROM turns")
def candidate_turns(spark, d):
    return dating.candidate_turns(_cycle(spark, d), 2).select("date", "kind", r6("value"))


@_query(_TURNS + """, r AS (SELECT *, CASE WHEN lag(kind) OVER (ORDER BY date) = kind THEN 0 ELSE 1 END AS new FROM turns),
g AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM r)
SELECT date, kind FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN kind = 'peak' THEN -value ELSE value END, date) AS k FROM g) WHERE k = 1""")
def alternating_turns(spark, d):
    return dating.alternating_turns(dating.candidate_turns(_cycle(spark, d), 2)).select("date", "kind")


@_query("""SELECT phase, min(date) AS start, max(date) AS "end", count(*) AS months FROM
 (SELECT *, sum(new) OVER (ORDER BY date) AS block FROM (SELECT date, phase, CASE WHEN lag(phase) OVER (ORDER BY date) = phase THEN 0 ELSE 1 END AS new FROM
   (SELECT date, CASE WHEN target >= 0 THEN 'up' ELSE 'down' END AS phase FROM target WHERE target IS NOT NULL))) GROUP BY block, phase""")
def gaps_islands_spans(spark, d):
    x = _cycle(spark, d).select("series", "date", F.when(F.col("value") >= 0, "up").otherwise("down").alias("phase"))
    return dating.chronology(x).select("phase", "start", "end", "months")


_SHORT = dating.Rules(window=2, min_phase=3, min_cycle=8, edge=2, level_smooth=2, min_run=2)


@_query()
def bry_boschan(spark, d):
    return dating.bry_boschan(_cycle(spark, d), _SHORT)


@_query()
def classify_phases(spark, d):
    return dating.date_cycle(_cycle(spark, d), _SHORT)[1]


# Factor


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return panel.apply_transform(base.dense(spark, d), "yoy").where("value is not null").select("date", "series", "value")


@_query()
def dfm_factor(spark, d):
    return factor.cycle_factor(_inputs(spark, d), reference="rev_asia")


@_query()
def dfm_factor_pit(spark, d):
    return factor.cycle_factor(_inputs(spark, d), reference="rev_asia", filtered=True)


@_query()
def dfm_factor_recursive(spark, d):
    return factor.cycle_factor_recursive(_inputs(spark, d), reference="rev_asia", min_months=48)
