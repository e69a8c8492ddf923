"""How much of a backtest is luck: deflated Sharpe ratio and combinatorially symmetric cross-validation."""

from __future__ import annotations

from itertools import combinations
from math import e, sqrt
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms as tr

EULER_GAMMA = 0.5772156649015329


def sharpe_moments(returns: DataFrame, by: str = "cfg_pos", *, ret: str = "ret") -> DataFrame:
    """Months, per-period Sharpe ratio, skewness and kurtosis (3 for a normal) of each series."""
    a = returns.where(F.col(ret).isNotNull()).groupBy(by).agg(F.count(ret).alias("t"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"), F.skewness(ret).alias("g3"), (F.kurtosis(ret) + 3).alias("g4"))
    return a.select(by, "t", F.coalesce(F.try_divide("m", F.nullif(F.col("sd"), F.lit(0.0))), F.lit(0.0)).alias("sr"), "g3", "g4")


def deflated_sharpe(t: int, sr: float, g3: float, g4: float, *, trials: int, trial_sharpes: list[float] | None = None, periods: int = 12) -> dict[str, float]:
    """Probability that the Sharpe ratio beats what the best of ``trials`` would reach by chance, from moments."""
    if t < 2:
        return {"sharpe": 0.0, "sharpe_annual": 0.0, "expected_max": 0.0, "standard_error": 0.0, "dsr": 0.0}
    error = sqrt(max(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12) / (t - 1))
    spread = error
    if trial_sharpes and len(trial_sharpes) > 1:
        mean = sum(trial_sharpes) / len(trial_sharpes)
        spread = sqrt(sum((x - mean) ** 2 for x in trial_sharpes) / (len(trial_sharpes) - 1))
    n, normal = max(trials, 2), NormalDist()
    best = spread * ((1 - EULER_GAMMA) * normal.inv_cdf(1 - 1 / n) + EULER_GAMMA * normal.inv_cdf(1 - 1 / (n * e)))
    return {"sharpe": sr, "sharpe_annual": sr * sqrt(periods), "expected_max": best, "standard_error": error, "dsr": normal.cdf((sr - best) / error)}


def complete_months(returns: DataFrame) -> DataFrame:
    """Rows of months in which every configuration has a return."""
    known = returns.where("ret is not null")
    n = known.agg(F.countDistinct("cfg_pos").alias("configs"))
    full = known.groupBy("date").agg(F.countDistinct("cfg_pos").alias("has")).join(F.broadcast(n), F.col("has") == F.col("configs")).select("date")
    return known.join(full, "date", "left_semi")


def block_sums(returns: DataFrame, blocks: int) -> DataFrame:
    """Contiguous blocks of months, and each configuration's count, sum and sum of squares in them.

    Returns are taken relative to the configuration's mean, so that the variance does not drown in rounding:
    ``cfg_pos, block, n, s1, s2, shift``.
    """
    full = complete_months(returns)
    block = full.select("date").distinct().select("date", F.ntile(blocks).over(Window.orderBy("date")).alias("block"))  # one row a month
    shift = F.avg("ret").over(Window.partitionBy("cfg_pos"))
    x = full.select("cfg_pos", "date", "ret", shift.alias("shift")).join(F.broadcast(block), "date")
    d = F.col("ret") - F.col("shift")
    return x.groupBy("cfg_pos", "block").agg(F.count("*").alias("n"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.first("shift").alias("shift"))


def split_table(spark: SparkSession, blocks: int) -> DataFrame:
    """Every choice of half the blocks: ``sid, block, side`` with side 1 for the chosen, in-sample half."""
    rows = [(i, b, int(b in half)) for i, half in enumerate(combinations(range(1, blocks + 1), blocks // 2)) for b in range(1, blocks + 1)]
    return spark.createDataFrame(rows, "sid int, block int, side int")


def overfitting(returns: DataFrame, *, partitions: int = 10) -> DataFrame:
    """Probability of backtest overfitting over all symmetric splits: one row ``pbo, logit_median, n_splits, n_configs``.

    ``returns`` is long, ``date, cfg_pos, ret``.  Each split takes its Sharpe ratios from block sums, so no return is
    read more than once; the table of splits is fixed by ``partitions``.
    """
    blocks = max(2, partitions - partitions % 2)
    splits = split_table(returns.sparkSession, blocks)
    sums = block_sums(returns, blocks)
    both = sums.join(F.broadcast(splits), "block").groupBy("sid", "side", "cfg_pos").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.first("shift").alias("shift"))
    mean = F.col("shift") + F.col("s1") / F.col("n")
    var = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1)
    sharpe = F.when(var > 1e-18 + 1e-14 * mean * mean, mean / F.sqrt(var)).otherwise(0.0)
    x = both.select("sid", "side", "cfg_pos", sharpe.alias("sr"))
    best = x.where("side = 1").withColumn("k", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("sr"), "cfg_pos"))).where("k = 1").select("sid", "cfg_pos")
    out = x.where("side = 0").select("sid", "cfg_pos", tr.average_rank("sr", "sid").alias("rank"), F.count("*").over(Window.partitionBy("sid")).alias("configs"))
    omega = F.col("rank") / (F.col("configs") + 1)
    logit = out.join(best, ["sid", "cfg_pos"]).select("sid", "configs", F.log(omega / (1 - omega)).alias("logit"))
    return logit.agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"),
        F.expr("percentile(logit, 0.5)").alias("logit_median"),
        F.count("*").alias("n_splits"),
        F.max("configs").alias("n_configs"),
    )
