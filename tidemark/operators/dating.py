"""Turning points of a cycle and its phases.

Candidates are found in Catalyst; the rules that look at the whole chronology (alternation, least lengths, merging of
short phases) are sequential, so each series is handled as a group of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import transforms as tr

#: The four phases in their order.
PHASES = ("Early Cycle", "Mid Cycle", "Late Cycle", "Downturn")


@dataclass(frozen=True)
class Rules:
    """Months: half window of an extremum, least phase, least cycle, margin at both ends, smoothing, least run."""

    window: int = 5
    min_phase: int = 5
    min_cycle: int = 18
    edge: int = 6
    level_smooth: int = 4
    min_run: int = 4


def candidate_turns(series: DataFrame, window: int = 5) -> DataFrame:
    """Local extrema over ``window`` months on either side: ``series, date, value, pos, months, kind``."""
    w = tr.series_window("series")
    x = series.where("value is not null").withColumn("pos", F.row_number().over(w) - 1).withColumn("months", F.count("*").over(Window.partitionBy("series")))
    kind = F.when(tr.is_local_extremum("value", w, window, "peak"), "peak").when(tr.is_local_extremum("value", w, window, "trough"), "trough")
    return x.withColumn("kind", kind).where("kind is not null").select("series", "date", "value", "pos", "months", "kind")


def alternating_turns(turns: DataFrame) -> DataFrame:
    """Of neighbouring turns of one kind the most extreme, the first of equals."""
    w = tr.series_window("series")
    x = turns.withColumn("run", tr.run_id("kind", w))
    height = F.when(F.col("kind") == "peak", -F.col("value")).otherwise(F.col("value"))
    k = F.row_number().over(Window.partitionBy("series", "run").orderBy(height, "date"))
    return x.withColumn("k", k).where("k = 1").drop("k", "run")


def _alternate(turns: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    out: list[tuple[int, str, float]] = []
    for t in turns:
        if not out or out[-1][1] != t[1]:
            out.append(t)
        elif (t[2] > out[-1][2]) if t[1] == "peak" else (t[2] < out[-1][2]):
            out[-1] = t
    return out


def space_out(turns: list[tuple[int, str, float]], min_phase: int, min_cycle: int) -> list[tuple[int, str, float]]:
    """Drop turns until all phases and cycles are long enough.

    ``turns`` are (position, kind, value) in order, alternating.  The earliest pair closer than ``min_phase`` loses the
    less extreme of the two (the lower of peak value and negated trough value; equals lose the later one).  Once all
    phases hold, the earliest cycle under ``min_cycle`` loses the turn in its middle.  Two turns are left alone.
    """
    turns = _alternate(turns)
    extreme = lambda t: t[2] if t[1] == "peak" else -t[2]
    while len(turns) > 2:
        close = next((i for i in range(len(turns) - 1) if turns[i + 1][0] - turns[i][0] < min_phase), None)
        if close is not None:
            gone = close if extreme(turns[close]) < extreme(turns[close + 1]) else close + 1
        else:
            short = next((i for i in range(len(turns) - 2) if turns[i + 2][0] - turns[i][0] < min_cycle), None)
            if short is None:
                break
            gone = short + 1
        turns = _alternate(turns[:gone] + turns[gone + 1 :])
    return turns


def bry_boschan(series: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Dated turning points: ``series, date, kind``."""
    first = alternating_turns(candidate_turns(series, rules.window))
    inner = first.where((F.col("pos") >= rules.edge) & (F.col("pos") < F.col("months") - rules.edge))

    def rule(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        left = space_out(list(zip(group["pos"], group["kind"], group["value"], strict=True)), rules.min_phase, rules.min_cycle)
        kept = {p for p, _, _ in left}
        return group.loc[group["pos"].isin(kept), ["series", "date", "kind"]]

    return inner.groupBy("series").applyInPandas(rule, "series string, date date, kind string")


def merge_short_runs(phases: list[str], least: int) -> list[str]:
    """Give the first run that is too short to its predecessor (at the start, its successor) until none is left."""
    out = list(phases)
    while out:
        starts = [i for i in range(len(out)) if i == 0 or out[i] != out[i - 1]]
        runs = list(zip(starts, [*starts[1:], len(out)], strict=True))
        short = next(((a, b) for a, b in runs if b - a < least), None)
        if short is None or len(runs) == 1:
            return out
        a, b = short
        out[a:b] = [out[a - 1] if a else out[b]] * (b - a)
    return out


def classify_phases(series: DataFrame, turns: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Regime and phase of every month: ``series, date, value, regime, phase``.

    A turn's month begins the new regime: expansion after a trough, contraction after a peak; before the first turn the
    opposite of what it begins; without turns the sign of the last change.  Within the regime the smoothed level decides.
    """
    w = tr.series_window("series")
    x = series.where("value is not null").join(turns.select("series", "date", "kind"), ["series", "date"], "left")
    latest = F.last("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    change = F.coalesce(tr.difference("value", w, 1), F.lit(0.0))
    up = F.when(latest == "trough", True).when(latest == "peak", False).when(first == "peak", True).when(first == "trough", False).otherwise(change >= 0)
    high = tr.rolling_mean("value", w, rules.level_smooth) >= 0
    phase = F.when(up & ~high, PHASES[0]).when(up & high, PHASES[1]).when(~up & high, PHASES[2]).otherwise(PHASES[3])
    x = x.select("series", "date", "value", F.when(up, "expansion").otherwise("contraction").alias("regime"), phase.alias("phase"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        return group.assign(phase=merge_short_runs(group["phase"].tolist(), rules.min_run))

    return x.groupBy("series").applyInPandas(merge, "series string, date date, value double, regime string, phase string")


def chronology(phases: DataFrame) -> DataFrame:
    """Spans of unbroken phases: ``series, block, phase, start, end, months``."""
    x = phases.withColumn("block", tr.run_id("phase", tr.series_window("series")))
    return x.groupBy("series", "block").agg(F.first("phase").alias("phase"), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("months"))


def date_cycle(series: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, phases and spans of each series."""
    turns = bry_boschan(series, rules)
    phases = classify_phases(series, turns, rules)
    return turns, phases, chronology(phases)
