"""One latent factor behind several monthly series, by expectation-maximisation over a Kalman smoother.

Each standardised series is a loading times the factor plus an own error.  The factor follows an autoregression of
order p, each error one of order 1; missing values are simply not observed, so ragged ends need no care.  The model is
small (months x series), so one model is one group; many models (the recursive estimate refits each month) are many
groups in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as tr

NOISE = 1e-4


@dataclass
class FactorModel:
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    ar: np.ndarray
    ar_noise: float
    rho: np.ndarray
    rho_noise: np.ndarray
    log_likelihood: list[float]

    def _system(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, n = len(self.ar), len(self.loadings)
        move = np.zeros((p + n, p + n))
        move[0, :p] = self.ar
        move[np.arange(1, p), np.arange(p - 1)] = 1
        move[np.arange(p, p + n), np.arange(p, p + n)] = self.rho
        shock = np.zeros(p + n)
        shock[0], shock[p:] = self.ar_noise, self.rho_noise
        see = np.zeros((n, p + n))
        see[:, 0] = self.loadings
        see[:, p:] = np.eye(n)
        return move, np.diag(shock), see

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def filter(self, z: np.ndarray):
        """Predicted and filtered means and covariances, and the log likelihood of ``z`` (NaN: not observed)."""
        move, shock, see = self._system()
        k, t = move.shape[0], len(z)
        a, c = np.zeros(k), np.eye(k)
        for _ in range(60):  # the stationary spread, near enough
            c = move @ c @ move.T + shock
        am, cm, af, cf, like = np.zeros((t, k)), np.zeros((t, k, k)), np.zeros((t, k)), np.zeros((t, k, k)), 0.0
        for i in range(t):
            if i:
                a, c = move @ a, move @ c @ move.T + shock
            am[i], cm[i] = a, c
            seen = ~np.isnan(z[i])
            if seen.any():
                h = see[seen]
                v = z[i, seen] - h @ a
                s = h @ c @ h.T + NOISE * np.eye(len(v))
                gain = np.linalg.solve(s, h @ c).T
                a, c = a + gain @ v, c - gain @ h @ c
                like -= 0.5 * (len(v) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + v @ np.linalg.solve(s, v))
            af[i], cf[i] = a, c
        return am, cm, af, cf, like

    def smooth(self, z: np.ndarray):
        """Smoothed means, covariances, covariances with the month before, and the log likelihood."""
        move, _, _ = self._system()
        am, cm, a, c, like = self.filter(z)
        a, c, lag = a.copy(), c.copy(), np.zeros_like(c)
        for i in range(len(z) - 2, -1, -1):
            back = np.linalg.solve(cm[i + 1], move @ c[i]).T
            a[i] += back @ (a[i + 1] - am[i + 1])
            lag[i + 1] = c[i + 1] @ back.T
            c[i] += back @ (c[i + 1] - cm[i + 1]) @ back.T
        return a, c, lag, like


def stable(ar: np.ndarray, most: float = 0.98) -> np.ndarray:
    """``ar`` with all its roots drawn in, by one factor, until none is longer than ``most``.

    A factor that explodes has no stationary spread to start the filter from.
    """
    longest = np.abs(np.roots(np.r_[1, -ar])).max(initial=0.0)
    return ar * min(1.0, most / max(longest, 1e-9)) ** np.arange(1, len(ar) + 1)


def fit_factor(x: np.ndarray, *, order: int = 2, iterations: int = 60, tolerance: float = 1e-5) -> FactorModel:
    """Fit to ``x`` (months x series, NaN for missing); starts from the first principal component."""
    mean, scale = np.nanmean(x, 0), np.nanstd(x, 0, ddof=1)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    full = np.where(np.isnan(z), 0.0, z)
    _, _, v = np.linalg.svd(full, full_matrices=False)
    f = full @ v[0]
    f /= f.std() or 1.0
    loadings = np.array([np.sum(f * full[:, i]) / np.sum(f[~np.isnan(z[:, i])] ** 2) for i in range(z.shape[1])])
    lagged = np.stack([f[order - 1 - k : len(f) - 1 - k] for k in range(order)], 1)
    ar = np.linalg.lstsq(lagged, f[order:], rcond=None)[0]
    error = full - np.outer(f, loadings)
    model = FactorModel(mean, scale, loadings, stable(ar), 0.3, np.full(z.shape[1], 0.3), error.var(0) * 0.9 + 1e-3, [])
    p, t = order, len(z)
    seen = ~np.isnan(z)
    for _ in range(iterations):
        a, c, lag, like = model.smooth(z)
        model.log_likelihood.append(like)
        if len(model.log_likelihood) > 1 and abs(like - model.log_likelihood[-2]) < tolerance * (1 + abs(like)):
            break
        second = c + a[:, :, None] * a[:, None, :]
        cross = lag[1:] + a[1:, :, None] * a[:-1, None, :]
        now, past, both = second[1:].sum(0), second[:-1].sum(0), cross.sum(0)
        ar = stable(np.linalg.solve(past[:p, :p], both[0, :p]), 0.999)
        noise = max(1e-6, (now[0, 0] - 2 * ar @ both[0, :p] + ar @ past[:p, :p] @ ar) / (t - 1))
        own = np.arange(p, p + z.shape[1])
        rho = np.clip(both[own, own] / past[own, own], -0.99, 0.99)
        rho_noise = np.maximum(1e-6, (now[own, own] - rho * both[own, own]) / (t - 1))
        fz = np.where(seen, full * a[:, [0]] - second[:, 0, p:], 0).sum(0)
        loadings = fz / np.maximum(1e-9, np.where(seen, second[:, [0], 0], 0).sum(0))
        model = FactorModel(mean, scale, loadings, ar, noise, rho, rho_noise, model.log_likelihood)
    return model


def _matrix(rows: pd.DataFrame) -> tuple[pd.DatetimeIndex, list[str], np.ndarray]:
    table = rows.assign(date=pd.to_datetime(rows["date"])).pivot_table(index="date", columns="series", values="value", aggfunc="mean", dropna=False).sort_index()
    table = table.loc[table.notna().any(axis=1)]
    return table.index, list(table.columns), table.to_numpy(float)


def _run(rows: pd.DataFrame, order: int, mode: str) -> pd.DataFrame:
    dates, names, x = _matrix(rows)
    model = fit_factor(x, order=order)
    z = model.standardised(x)
    f = model.filter(z)[2][:, 0] if mode == "filtered" else model.smooth(z)[0][:, 0]
    return pd.DataFrame({"date": [d.date() for d in dates], "factor": f})


def _signed(factor: DataFrame, reference: DataFrame) -> DataFrame:
    """Turn the factor to correlate positively with the reference, then standardise over the sample."""
    sign = factor.join(reference.select("date", F.col("value").alias("ref")), "date", "left").agg(F.when(F.corr("ref", "factor") < 0, -1.0).otherwise(1.0).alias("sign"), F.avg("factor").alias("m"), F.stddev_samp("factor").alias("s"))
    return factor.join(F.broadcast(sign), how="cross").select("date", (F.col("sign") * F.try_divide(F.col("factor") - F.col("m"), F.nullif(F.col("s"), F.lit(0.0)))).alias("factor"))


def cycle_factor(inputs: DataFrame, *, reference: str, order: int = 2, filtered: bool = False) -> DataFrame:
    """Full-sample factor of long ``inputs`` (date, series, value): ``date, factor``.

    Smoothed; or filtered, where a month sees no later observation, although the parameters and the scale are those of
    the full sample (a pseudo-real-time estimate).
    """
    mode = "filtered" if filtered else "smoothed"
    raw = inputs.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda g: _run(g, order, mode), "date date, factor double")  # one model
    return _signed(raw, inputs.where(F.col("series") == reference))


def loadings(inputs: DataFrame, factor: DataFrame) -> DataFrame:
    """Correlation of every input with the factor, largest first: ``series, corr``."""
    return inputs.join(factor, "date").groupBy("series").agg(F.corr("value", "factor").alias("corr")).orderBy(F.desc("corr"), "series")


def cycle_factor_recursive(inputs: DataFrame, *, reference: str, order: int = 2, step: int = 1, min_months: int = 72) -> DataFrame:
    """Real-time factor: for each month the last smoothed value of a model fitted up to it: ``date, factor, error``.

    The months are dealt out; a fold that fails has a NULL factor and the message.
    """
    spark = inputs.sparkSession
    data = spark.sparkContext.broadcast(inputs.select("date", "series", "value").toPandas())  # months x series
    months = inputs.where("value is not null").select("date").distinct()
    pos = months.withColumn("pos", F.sum(F.lit(1)).over(tr.series_window(order="date")))
    folds = pos.where((F.col("pos") >= min_months) & ((F.col("pos") - min_months) % step == 0)).select("date")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = data.value.assign(date=pd.to_datetime(data.value["date"]))
        for part in parts:
            out = []
            for day in pd.to_datetime(part["date"]):
                try:
                    past = rows[rows["date"] <= day]
                    f = _run(past, order, "smoothed").set_index("date")["factor"]
                    ref = past[past["series"] == reference].set_index("date")["value"]
                    ref.index = ref.index.date
                    sign = -1.0 if f.corr(ref) < 0 else 1.0
                    out.append((day.date(), float(sign * (f.iloc[-1] - f.mean()) / f.std()), None))
                except (np.linalg.LinAlgError, ValueError, ZeroDivisionError) as x:
                    out.append((day.date(), None, repr(x)))
            yield pd.DataFrame(out, columns=["date", "factor", "error"])

    return folds.repartition(max(1, spark.sparkContext.defaultParallelism), "date").mapInPandas(run, "date date, factor double, error string")


def compare_factors(filtered: DataFrame, recursive: DataFrame) -> DataFrame:
    """Two estimates of the factor in the months that both have: ``months, corr``."""
    both = filtered.select("date", F.col("factor").alias("a")).join(recursive.select("date", F.col("factor").alias("b")), "date").na.drop()
    return both.agg(F.count("*").alias("months"), F.corr("a", "b").alias("corr"))
