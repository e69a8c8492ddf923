"""Forecast models as plain functions ``fit(x_train, y_train, x_test) -> predictions`` on one fold's tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _impute(train: pd.DataFrame, test: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Missing values become the training median; a column without any value is left out."""
    middle = train.median()
    some = middle.index[middle.notna()]
    return train[some].fillna(middle).to_numpy(float), test[some].fillna(middle).to_numpy(float)


def ar_benchmark(columns: Sequence[str]):
    """Least squares on the target's own known lags."""

    def fit(x: pd.DataFrame, y: pd.Series, test: pd.DataFrame) -> np.ndarray:
        cols = [c for c in columns if c in x]
        a, b = _impute(x[cols], test[cols])
        coef = np.linalg.lstsq(np.c_[np.ones(len(a)), a], y.to_numpy(float), rcond=None)[0]
        return np.c_[np.ones(len(b)), b] @ coef

    return fit


def _lasso_path(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, ratio: float, sweeps: int = 200) -> np.ndarray:
    """Elastic-net coefficients for falling penalties by cyclic coordinate descent on the Gram matrix."""
    n, d = x.shape
    gram, xy = x.T @ x / n, x.T @ y / n
    w, out = np.zeros(d), []
    for alpha in alphas:
        for _ in range(sweeps):
            old = w.copy()
            for j in range(d):
                r = xy[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - alpha * ratio, 0) / (gram[j, j] + alpha * (1 - ratio) + 1e-12)
            if np.abs(w - old).max() < 1e-5:
                break
        out.append(w.copy())
    return np.array(out)


def elastic_net(ratios: Sequence[float] = (0.1, 0.5, 0.9, 1.0), n_alphas: int = 20, cv: int = 4):
    """Median imputation, standardisation, elastic net with penalty and mix chosen on contiguous folds."""

    def fit(x: pd.DataFrame, y: pd.Series, test: pd.DataFrame) -> np.ndarray:
        a, b = _impute(x, test)
        mean, sd = a.mean(0), a.std(0)
        sd = np.where(sd > 0, sd, 1.0)
        a, b, level = (a - mean) / sd, (b - mean) / sd, y.mean()
        t = y.to_numpy(float) - level
        parts = np.array_split(np.arange(len(a)), cv)
        best = (np.inf, 1.0, 1.0)
        for ratio in ratios:
            top = np.abs(a.T @ t).max() / len(a) / ratio
            alphas = np.geomspace(max(top, 1e-9), max(top, 1e-9) * 1e-3, n_alphas)
            errors = np.zeros(n_alphas)
            for p in parts:
                rest = np.setdiff1d(np.arange(len(a)), p)
                centre, shift = a[rest].mean(0), t[rest].mean()
                path = _lasso_path(a[rest] - centre, t[rest] - shift, alphas, ratio)
                errors += ((t[p][:, None] - shift - (a[p] - centre) @ path.T) ** 2).mean(0)
            k = int(errors.argmin())
            best = min(best, (errors[k], ratio, alphas[k]))
        _, ratio, alpha = best
        top = np.abs(a.T @ t).max() / len(a) / ratio
        w = _lasso_path(a, t, np.geomspace(max(top, alpha), alpha, 10), ratio)[-1]
        return level + b @ w

    return fit


def boosted_trees(rounds: int = 60, rate: float = 0.1, min_leaf: int = 8, bins: int = 16, gains: dict[str, float] | None = None):
    """Gradient boosting of two-leaf trees on quantile bins; missing values go to the side that fits better.

    All splits of all columns are scored at once from the sums of the residuals by bin.  What each split takes off the
    squared error is added to ``gains`` under its column, if that is given.
    """

    def fit(x: pd.DataFrame, y: pd.Series, test: pd.DataFrame) -> np.ndarray:
        a, b = x.to_numpy(float), test.to_numpy(float)
        n, d = a.shape
        level = float(y.mean())
        r, out = y.to_numpy(float) - level, np.full(len(b), level)
        cuts = np.full((d, bins - 1), np.inf)
        for j, c in enumerate(a.T):
            points = np.unique(np.quantile(c[~np.isnan(c)], np.linspace(0, 1, bins + 1)[1:-1])) if (~np.isnan(c)).any() else []
            cuts[j, : len(points)] = points
        # Bin of each value; the last one is for missing values.
        place = lambda m: np.where(np.isnan(m), bins, np.stack([np.searchsorted(cuts[j], m[:, j], side="left") for j in range(d)], 1)) if len(m) else np.zeros(m.shape, int)
        mine, theirs = place(a), place(b)
        flat = (mine + np.arange(d) * (bins + 1)).ravel()
        by_bin = lambda w: np.bincount(flat, np.repeat(w, d), d * (bins + 1)).reshape(d, bins + 1)
        count = by_bin(np.ones(n))
        left_n = np.cumsum(count[:, : bins - 1], 1)
        left_n = np.stack([left_n, left_n + count[:, -1:]])  # missing right, missing left
        ok = (left_n >= min_leaf) & (n - left_n >= min_leaf)
        for _ in range(rounds):
            s = by_bin(r)
            left = np.cumsum(s[:, : bins - 1], 1)
            left = np.stack([left, left + s[:, -1:]])
            total = r.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, left**2 / left_n + (total - left) ** 2 / (n - left_n) - total**2 / n, -1.0)
            side, col, cut = np.unravel_index(gain.argmax(), gain.shape)
            if gain[side, col, cut] <= 1e-12:
                break
            if gains is not None:
                gains[x.columns[col]] = gains.get(x.columns[col], 0.0) + float(gain[side, col, cut])
            k, v = left_n[side, col, cut], left[side, col, cut]
            goes_left = lambda m: (m[:, col] <= cut) | ((m[:, col] == bins) & bool(side))  # noqa: B023, E731
            r = r - rate * np.where(goes_left(mine), v / k, (total - v) / (n - k))
            out = out + rate * np.where(goes_left(theirs), v / k, (total - v) / (n - k))
        return out

    return fit


def tree_gains(wide: DataFrame, *, target: str = "y", rounds: int = 300, **rule) -> DataFrame:
    """Gains by feature of trees fitted to all months: ``feature, gain``; a feature that never splits has 0.

    One fit of one table (months x features), in one task.
    """
    columns = [c for c in wide.columns if c not in ("date", target)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat([pd.DataFrame(columns=["date", *columns, target]), *parts]).sort_values("date")
        found: dict[str, float] = {}
        if len(table):
            boosted_trees(rounds, gains=found, **rule)(table[columns].astype(float), table[target].astype(float), table[columns].iloc[:0].astype(float))
        yield pd.DataFrame({"feature": columns, "gain": [found.get(c, 0.0) for c in columns]})

    return wide.select("date", *columns, target).coalesce(1).mapInPandas(run, "feature string, gain double")


def registry(benchmark: Sequence[str]) -> dict:
    """The models by name."""
    return {"ar_benchmark": ar_benchmark(benchmark), "elasticnet": elastic_net(), "gbt": boosted_trees()}
