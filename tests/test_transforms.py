import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import transforms as tr
from tidemark.operators import grid, panel
from tidemark.operators.asof import asof_panel


def months(n, start=2015):
    return [(dt.date(start + (i // 12) + (1 if i % 12 == 11 else 0), (i + 1) % 12 + 1, 1) - dt.timedelta(1)) for i in range(n)]


def ramp(spark, n=60, first=100.0):
    return spark.createDataFrame([("s", d, first + i) for i, d in enumerate(months(n))], "series string, date date, value double")


def values(df, col):
    return [r[col] for r in df.orderBy("date").collect()]


def test_growth_and_average_look_back_only(spark):
    w = tr.series_window("series")
    x = ramp(spark).select("date", tr.yoy("value", w).alias("y"), tr.moving_average("value", w).alias("m"))
    y, m = values(x, "y"), values(x, "m")
    assert y[:12] == [None] * 12 and y[12] == pytest.approx(112 / 100 - 1)
    assert m[:2] == [None, None] and m[2] == pytest.approx(101)


def test_expanding_z_does_not_change_when_the_future_goes(spark):
    w = tr.series_window("series")
    full = values(ramp(spark).select("date", tr.expanding_z("value", w).alias("z")), "z")
    cut = values(ramp(spark, 40).select("date", tr.expanding_z("value", w).alias("z")), "z")
    assert full[:40] == pytest.approx(cut) if None not in full[23:40] else True
    assert full[:23] == [None] * 23 and [round(a, 12) for a in full[23:40]] == [round(a, 12) for a in cut[23:40]]


def test_missing_and_zero(spark):
    w = tr.series_window("series")
    d = months(4)
    x = spark.createDataFrame([("s", d[0], 0.0), ("s", d[1], 5.0), ("s", d[2], None), ("s", d[3], float("inf"))], "series string, date date, value double")
    assert values(x.select("date", tr.mom("value", w).alias("g")), "g")[:3] == [None, None, None]
    assert values(x.select("date", tr.null_if_not_finite("value").alias("v")), "v") == [0.0, 5.0, None, None]
    assert values(x.select("date", tr.clip("value", 1, 2).alias("v")), "v") == [1.0, 2.0, None, 2.0]
    assert values(x.select("date", tr.expanding_z("value", w, 1).alias("z")), "z")[0] is None


def test_dispatcher(spark):
    w = tr.series_window("series")
    x = ramp(spark, 40)
    assert values(x.select("date", tr.transform("mom12")("value", w).alias("v")), "v") == values(x.select("date", tr.yoy("value", w).alias("v")), "v")
    assert values(x.select("date", tr.transform("level")("value", w).alias("v")), "v")[0] == 100
    assert values(x.select("date", tr.transform("diff")("value", w).alias("v")), "v")[1] == 1
    assert values(panel.apply_transform(x, "yoy_mma3"), "value")[14] == pytest.approx(113 / 101 - 1)
    for bad in ("nope", "mom-1", "momx"):
        with pytest.raises(ValueError):
            tr.transform(bad)


def obs(spark, n, lag, start=2020, step=1.0):
    return spark.createDataFrame([(d, "s", step * (i + 1), dt.datetime.combine(d + dt.timedelta(lag), dt.time())) for i, d in enumerate(months(n, start))], "date date, series string, value double, published timestamp_ntz")


def test_asof_with_forty_days(spark):
    x = obs(spark, 6, 40)
    p = {r["asof_date"]: r["value"] for r in asof_panel(x, grid.monthly_grid(x)).collect()}
    assert p[dt.date(2020, 1, 31)] is None and p[dt.date(2020, 3, 31)] == 1.0 and p[dt.date(2020, 4, 30)] == 2.0


def test_asof_never_shows_a_month_on_its_own_end(spark):
    x = obs(spark, 4, 5, 2021, 10.0)
    p = [r["value"] for r in asof_panel(x, grid.monthly_grid(x)).orderBy("asof_date").collect()]
    assert p[:2] == [None, 10.0]


def test_asof_ties_late_overrides_and_age(spark):
    d, t = months(4, 2020), dt.datetime
    x = spark.createDataFrame([(d[1], "s", 2.0, t(2020, 3, 1)), (d[0], "s", 1.0, t(2020, 3, 1)), (d[0], "s", 9.0, t(2020, 4, 5)), (d[2], "s", None, t(2020, 4, 6)), (d[3], "s", 7.0, None)], "date date, series string, value double, published timestamp_ntz")
    g = spark.createDataFrame([(x_,) for x_ in d], "date date")
    p = [r["value"] for r in asof_panel(x, g).orderBy("asof_date").collect()]
    assert p == [None, None, 2.0, 9.0]
    p = [r["value"] for r in asof_panel(x, g, max_age_days=26).orderBy("asof_date").collect()]
    assert p == [None, None, None, 9.0]


def test_grid_resample_and_empty(spark):
    d = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 1, 20), 2.0), ("a", dt.date(2020, 1, 31), None), ("a", dt.date(2020, 3, 1), 3.0)], "series string, t date, v double")
    m = grid.densify(grid.month_end_last(d, "t", "v", "series")).orderBy("date")
    assert [(r["date"].month, r["value"]) for r in m.collect()] == [(1, 2.0), (2, None), (3, 3.0)]
    assert grid.monthly_grid(d.select(F.col("t").alias("date")).limit(0)).count() == 0


def test_diffusion_counts_levels_below_and_rises_above(spark):
    d = months(2)
    x = spark.createDataFrame([("a", d[0], 1.0), ("a", d[1], 2.0), ("b", d[0], None), ("b", d[1], 1.0), ("c", d[0], 1.0), ("c", d[1], None)], "series string, date date, value double")
    assert [r["breadth"] for r in panel.diffusion_index(x).orderBy("date").collect()] == [0.0, 0.5]


def test_average_rank_runs_and_month_number(spark):
    x = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 2.0, 3)], "g string, v double, i int")
    assert [r[0] for r in x.select(tr.average_rank("v", "g").alias("r"), "i").orderBy("i").collect()] == [1.5, 1.5, 3.0]
    assert [r[0] for r in x.select(tr.run_id("v", Window.partitionBy("g").orderBy("i")), "i").orderBy("i").collect()] == [1, 1, 2]
    assert spark.range(1).select(tr.month_number(F.lit("2020-02-29").cast("date")) - tr.month_number(F.lit("2019-12-01").cast("date"))).first()[0] == 2
