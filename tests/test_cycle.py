import numpy as np
import pandas as pd
import pytest
from test_transforms import months

from tidemark.operators import dating, evaluate, factor, models


def waves(spark, cycles=5, up=34, down=14):
    """Long climbs and short falls with a slow drift, as business cycles have them."""
    g = np.random.default_rng(77)
    shape = np.concatenate([np.linspace(-1, 1, up, endpoint=False), np.linspace(1, -1, down, endpoint=False)])
    y = np.tile(shape, cycles) + np.linspace(0, 0.4, cycles * (up + down)) + g.uniform(-0.04, 0.04, cycles * (up + down))
    return spark.createDataFrame([("s", d, float(v)) for d, v in zip(months(len(y), 1981), y, strict=True)], "series string, date date, value double")


def test_turns_alternate_and_cycles_are_long(spark):
    t = dating.bry_boschan(waves(spark)).orderBy("date").toPandas()
    kinds = t["kind"].tolist()
    assert 7 <= len(t) <= 10 and all(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    m = pd.to_datetime(t["date"]).dt.year * 12 + pd.to_datetime(t["date"]).dt.month
    assert (m.diff(2).dropna() >= 18).all() and (m.diff().dropna() >= 5).all()


def test_phases_agree_with_regimes_and_have_no_short_runs(spark):
    _, phases, spans = dating.date_cycle(waves(spark), dating.Rules(min_run=3))
    assert spans.where("months < 3").count() == 0
    p = phases.toPandas()
    raw = dating.Rules(min_run=1)
    p = dating.date_cycle(waves(spark), raw)[1].toPandas()
    assert (p["phase"].isin(["Early Cycle", "Mid Cycle"]) == (p["regime"] == "expansion")).all()


def test_rules_by_hand():
    assert dating.space_out([(0, "peak", 5.0), (3, "trough", 4.0), (20, "peak", 6.0), (40, "trough", 1.0)], 5, 10) == [(20, "peak", 6.0), (40, "trough", 1.0)]
    assert dating.merge_short_runs(list("aabbbccccc"), 3) == list("bbbbbccccc")
    assert dating.merge_short_runs(["a"], 3) == ["a"] and dating.merge_short_runs([], 3) == []
    assert dating.merge_short_runs(list("aaaabcccc"), 2) == list("aaaaacccc")


def factor_panel(n=312):
    """Four noisy series of one slow factor of order two, the last with the opposite sign."""
    g = np.random.default_rng(2024)
    f = np.zeros(n)
    for t in range(2, n):
        f[t] = 1.3 * f[t - 1] - 0.4 * f[t - 2] + g.standard_normal()
    x = np.outer(f, [0.5, 0.45, 0.7, -0.35]) + g.standard_normal((n, 4)) * [0.6, 0.4, 0.9, 0.5]
    x[-2:, 2] = np.nan
    x[100:118, 1] = np.nan
    return f, x


def test_factor_is_recovered_and_likelihood_rises():
    f, x = factor_panel()
    model = factor.fit_factor(x)
    smooth = model.smooth(model.standardised(x))[0][:, 0]
    assert abs(np.corrcoef(f, smooth)[0, 1]) > 0.93
    like = np.array(model.log_likelihood)
    assert (np.diff(like) > -1e-3 * np.abs(like[1:])).all()
    z = model.standardised(x)
    full, cut = model.filter(z)[2][:137, 0], model.filter(z[:137])[2][:, 0]
    assert np.allclose(full, cut)


def test_factor_frames(spark):
    f, x = factor_panel()
    rows = [(d, f"x{j}", None if np.isnan(v) else float(v)) for i, d in enumerate(months(len(f), 1995)) for j, v in enumerate(x[i])]
    long = spark.createDataFrame(rows, "date date, series string, value double")
    got = factor.cycle_factor(long, reference="x2").orderBy("date").toPandas()["factor"]
    assert len(got) == len(f) and np.corrcoef(f, got)[0, 1] > 0.93 and abs(got.mean()) < 1e-9
    real = factor.cycle_factor_recursive(long.where("date < '2003-01-01'"), reference="x2", min_months=70, step=6)
    assert real.where("error is not null").count() == 0 and real.count() == 5


def test_walk_forward_respects_the_gap(spark):
    n = 160
    wide = spark.createDataFrame([(d, float(i), float(i)) for i, d in enumerate(months(n, 2000))], "date date, f double, y double")
    spy = {"last": lambda x, y, t: np.array([y.iloc[-1]]), "size": lambda x, y, t: np.array([float(len(x))])}
    out = evaluate.walk_forward(wide, spy, horizon=3, min_train=60).toPandas()
    assert ((out["y_true"] - out["pred_last"]) == 7).all() and (out["pred_size"] == out["n_train"]).all() and out["n_train"].min() == 61


def test_models_learn_a_line():
    g = np.random.default_rng(0)
    x = pd.DataFrame(g.normal(size=(200, 4)), columns=list("abcd"))
    x.loc[3, "a"] = np.nan
    y = 2 * x["a"].fillna(0) - x["b"] + 0.05 * pd.Series(g.normal(size=200))
    for fit in (models.ar_benchmark(["a", "b"]), models.elastic_net(n_alphas=10), models.boosted_trees(200)):
        p = fit(x[:150], y[:150], x[150:])
        assert np.corrcoef(p, y[150:])[0, 1] > 0.9


# A few published out-of-sample months need not be copied; the scoreboard is held against its definition.
def test_scoreboard(spark):
    g = np.random.default_rng(0)
    y = np.cumsum(g.normal(size=80))
    a, b = y + g.normal(size=80) * 0.3, y * 0.5
    rows = [(d, float(v), 50, float(p), float(q)) for d, v, p, q in zip(months(80, 2006), y, a, b, strict=True)]
    oos = spark.createDataFrame(rows, "date date, y_true double, n_train int, pred_ar_benchmark double, pred_x double")
    s = {r["model"]: r for r in evaluate.scoreboard(oos).collect()}
    move = np.abs(np.diff(y))
    turn = np.r_[False, move >= np.quantile(move, 0.67)]
    assert s["x"]["MAE"] == pytest.approx(np.abs(y - b).mean()) and s["x"]["skill_vs_AR"] == pytest.approx(1 - np.abs(y - b).mean() / np.abs(y - a).mean())
    assert s["x"]["MAE_turns"] == pytest.approx(np.abs(y - b)[turn].mean())
    side = np.sign(y[1:] - y[:-1]) == np.sign(a[1:] - y[:-1])
    assert s["ar_benchmark"]["turn_acc"] == pytest.approx(side.mean()) and s["ar_benchmark"]["turn_acc_turns"] == pytest.approx(side[turn[1:]].mean())


@pytest.mark.parametrize("noise", [0.01, 0.001])
def test_a_factor_with_an_outlier_at_the_end_does_not_explode(noise):
    """Growth of monthly sums whose last month has one day: the start's autoregression had roots beyond the unit circle."""
    for seed in range(6):
        g = np.random.default_rng(seed)
        days = np.append(np.tile([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], 7)[:79], 1)
        sums = days[:, None] * (1 + noise * g.standard_normal((80, 5)))
        x = sums[12:] / sums[:-12] - 1
        model = factor.fit_factor(x)
        f = model.smooth(model.standardised(x))[0][:, 0]
        assert np.isfinite(f).all() and np.abs(np.roots(np.r_[1, -model.ar])).max() < 1
        assert abs(np.corrcoef(f, x.mean(1))[0, 1]) > 0.99


def test_roots_are_drawn_in_only_where_they_are_too_long():
    assert (factor.stable(np.array([0.5, 0.3])) == [0.5, 0.3]).all() and (factor.stable(np.zeros(2)) == 0).all()
    assert np.abs(np.roots(np.r_[1, -factor.stable(np.array([-0.7, 0.9]))])).max() == pytest.approx(0.98)
