"""Causal transforms of monthly series as Column expressions.

Every function takes the value column and a window ordered by month (``series_window``), stays in Catalyst, and looks
backwards only.  NULL is the one missing marker; division by zero gives NULL; rows are positional, so the months of a
series must be contiguous (``operators.grid.densify``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series_window(*by: str, order: str = "date") -> WindowSpec:
    """Months of one series in order; never a window over all rows unless ``by`` is empty on purpose."""
    return Window.partitionBy(*by).orderBy(order)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_not_finite(x: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def growth(x: Column | str, w: WindowSpec, months: int) -> Column:
    """x over its value ``months`` rows before, minus one."""
    return F.try_divide(_col(x), F.lag(x, months).over(w)) - 1


def yoy(x: Column | str, w: WindowSpec) -> Column:
    return growth(x, w, 12)


def mom(x: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return growth(x, w, n)


def moving_average(x: Column | str, w: WindowSpec, n: int = 3) -> Column:
    """Mean of the last n rows; NULL unless all n are there and not NULL."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def rolling_mean(x: Column | str, w: WindowSpec, n: int) -> Column:
    """Mean of what the last n rows hold."""
    return F.avg(x).over(w.rowsBetween(-(n - 1), 0))


def expanding_z(x: Column | str, w: WindowSpec, min_periods: int = 24) -> Column:
    """Deviation from the mean so far in sample standard deviations; needs ``min_periods`` values, and a spread."""
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    z = F.try_divide(_col(x) - F.avg(x).over(past), F.nullif(F.stddev_samp(x).over(past), F.lit(0.0)))
    return F.when(F.count(x).over(past) >= min_periods, z)


def difference(x: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return _col(x) - F.lag(x, n).over(w)


def forward_fill(x: Column | str, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cumulative_growth(r: Column | str, w: WindowSpec) -> Column:
    """Product of 1 + r so far; the first row is 1 + r, there is no base row."""
    return F.product(1 + _col(r)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(curve: Column | str, w: WindowSpec) -> Column:
    return F.try_divide(_col(curve), F.max(curve).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1


def run_id(x: Column | str, w: WindowSpec) -> Column:
    """Number of the run of equal values, from 1."""
    changed = F.lag(x).over(w).isNull() | (F.lag(x).over(w) != _col(x))
    return F.sum(F.when(changed, 1).otherwise(0)).over(w)


def standardise(x: Column | str, everything: WindowSpec) -> Column:
    """(x - mean) / sample deviation over a whole partition (no ``orderBy`` in the window)."""
    return F.try_divide(_col(x) - F.avg(x).over(everything), F.nullif(F.stddev_samp(x).over(everything), F.lit(0.0)))


def clip(x: Column | str, low: float, high: float) -> Column:
    """Bounded x; NULL stays NULL (greatest and least alone would turn it into a bound)."""
    return F.when(_col(x).isNotNull(), F.greatest(F.least(_col(x), F.lit(high)), F.lit(low)))


def month_number(d: Column | str) -> Column:
    """Months since year 0: differences count calendar months, whatever the days."""
    return F.year(d) * 12 + F.month(d)


def is_local_extremum(x: Column | str, w: WindowSpec, k: int, kind: str) -> Column:
    """x is the largest ('peak') or smallest ('trough') of the k rows on either side, all of which exist, and is
    strictly beyond the row before or the row after."""
    frame = w.rowsBetween(-k, k)
    full = F.count(F.lit(1)).over(frame) == 2 * k + 1
    before, after = F.lag(x, 1).over(w), F.lead(x, 1).over(w)
    if kind == "peak":
        return full & (_col(x) == F.max(x).over(frame)) & ((_col(x) > before) | (_col(x) > after))
    return full & (_col(x) == F.min(x).over(frame)) & ((_col(x) < before) | (_col(x) < after))


def average_rank(x: Column | str, *by: str) -> Column:
    """Ascending rank within the group; ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def transform(spec: str) -> Callable[[Column | str, WindowSpec], Column]:
    """The transform that a configuration string names: yoy, yoy_mma3, level, diff, mom<n>, mma<n>.

    ``yoy_mma3`` needs the moving average as a column of its own (windows do not nest); ``operators.panel`` applies it
    in two steps, so here it is refused together with unknown names.
    """
    if spec == "level":
        return lambda x, w: _col(x)
    if spec == "yoy":
        return yoy
    if spec == "diff":
        return difference
    for name, fn in (("mom", mom), ("mma", moving_average)):
        if spec.startswith(name):
            n = spec.removeprefix(name) or {"mom": "1", "mma": "3"}[name]
            if n.isdigit() and int(n) > 0:
                return lambda x, w: fn(x, w, int(n))
    raise ValueError(f"unknown transform {spec!r}")
