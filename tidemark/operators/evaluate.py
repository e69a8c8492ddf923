"""Walk-forward evaluation with purge and embargo, benchmark forecasts, scoreboard."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import transforms as tr


def folds(months: DataFrame, *, horizon: int, min_train: int = 96, step: int = 1, purge: int = 3, embargo: int = 1, start: str | None = None) -> DataFrame:
    """Test months and the number of training rows each may use: ``test_date, n_train``.

    A row may train a test month if it lies ``horizon + purge + embargo`` calendar months or more before it.  The first
    test month stands at position ``min_train + gap`` at least, and not before ``start``.
    """
    gap = horizon + purge + embargo
    x = months.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1).withColumn("m", tr.month_number("date"))
    early = F.lit(0) if start is None else F.sum(F.when(F.col("date") < F.lit(start).cast("date"), 1).otherwise(0)).over(Window.partitionBy())
    test = x.withColumn("first", F.greatest(F.lit(min_train + gap), early)).where("pos >= first").where((F.col("pos") - F.col("first")) % step == 0)
    test = test.select(F.col("date").alias("test_date"), F.col("pos").alias("test_pos"), F.col("m").alias("test_m"))
    # The rows that may train form a prefix, so counting is enough to know them.
    train = test.join(x, (F.col("test_m") - F.col("m") >= gap) & (F.col("pos") < F.col("test_pos"))).groupBy("test_date").agg(F.count("*").alias("n_train"))
    return train.where(F.col("n_train") >= min_train)


Model = Callable[[pd.DataFrame, pd.Series, pd.DataFrame], np.ndarray]


def walk_forward(wide: DataFrame, models: dict[str, Model], *, horizon: int, target: str = "y", **rule) -> DataFrame:
    """Out-of-sample predictions: ``date, y_true, n_train, pred_<model>...``; every fold is fitted on its own.

    ``wide`` has ``date``, the target and the features, one row a month.  Folds are independent, so they are dealt out:
    the table (months, not observations) goes to every task, the folds are the partitioning.
    """
    spark = wide.sparkSession
    columns = [c for c in wide.columns if c not in ("date", target)]
    table = wide.orderBy("date").toPandas()  # months x features
    data = spark.sparkContext.broadcast(table)
    test = folds(spark.createDataFrame([(x,) for x in table["date"]], "date date"), horizon=horizon, **rule)
    n = min(200, max(1, spark.sparkContext.defaultParallelism * 2))

    def run(parts):
        table = data.value
        dates = pd.to_datetime(table["date"])
        x, y = table[columns].astype(float), table[target].astype(float)
        for part in parts:
            rows = []
            for day, k in zip(pd.to_datetime(part["test_date"]), part["n_train"], strict=True):
                at = int((dates == day).to_numpy().argmax())
                preds = [float(fit(x.iloc[:k], y.iloc[:k], x.iloc[[at]])[0]) for fit in models.values()]
                rows.append((day.date(), float(y.iloc[at]), int(k), *preds))
            yield pd.DataFrame(rows, columns=["date", "y_true", "n_train", *[f"pred_{m}" for m in models]])

    schema = "date date, y_true double, n_train bigint, " + ", ".join(f"pred_{m} double" for m in models)
    return test.repartition(n, "test_date").mapInPandas(run, schema)


def ar_benchmark_oos(target: DataFrame, *, horizon: int, **rule) -> DataFrame:
    """Forecast of y by a straight line through its last known value, per fold by grouped sums alone.

    ``target`` has ``date, x, y``; rows as in ``walk_forward``: ``date, y_true, n_train, pred_ar``.
    """
    known = target.where("x is not null and y is not null")
    order = known.withColumn("pos", F.row_number().over(Window.orderBy("date")))
    past = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = order.select("pos", *[e.over(past).alias(n) for n, e in (("k", F.count("*")), ("sx", F.sum("x")), ("sy", F.sum("y")), ("sxx", F.sum(F.col("x") * F.col("x"))), ("sxy", F.sum(F.col("x") * F.col("y"))))])
    test = folds(known, horizon=horizon, **rule)
    x = test.join(order.select(F.col("date").alias("test_date"), "x", "y"), "test_date").join(sums, F.col("n_train") == F.col("pos"))
    slope = F.try_divide(F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy"), F.nullif(F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)))
    x = x.withColumn("slope", F.coalesce(slope, F.lit(0.0))).withColumn("level", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("k"))
    return x.select(F.col("test_date").alias("date"), F.col("y").alias("y_true"), "n_train", (F.col("level") + F.col("slope") * F.col("x")).alias("pred_ar"))


def scoreboard(oos: DataFrame, *, benchmark: str = "ar_benchmark", since: str | None = None, turn_quantile: float = 0.67) -> DataFrame:
    """Eight measures of each ``pred_<model>``, sorted by MAE.

    Turns are the months whose target moved by at least the ``turn_quantile`` of all moves.  ``turn_acc`` asks whether
    prediction and outcome lie on the same side of the previous outcome; the first month has none.
    """
    models = [c for c in oos.columns if c.startswith("pred_")]
    x = oos if since is None else oos.where(F.col("date") >= F.lit(since).cast("date"))
    w = Window.orderBy("date")  # one row a month
    x = x.withColumn("before", F.lag("y_true").over(w)).withColumn("move", F.abs(F.col("y_true") - F.col("before")))
    cut = x.agg(F.expr(f"percentile(move, {turn_quantile})").alias("cut"))
    x = x.join(F.broadcast(cut), how="cross").withColumn("turn", F.col("move") >= F.col("cut"))
    pairs = F.array(*[F.struct(F.lit(m.removeprefix("pred_")).alias("model"), F.col(m).alias("p")) for m in models])
    x = x.select("date", "y_true", "before", "turn", F.inline(pairs)).where("p is not null and y_true is not null")
    err = F.abs(F.col("y_true") - F.col("p"))
    same = (F.signum("y_true") == F.signum("p")).cast("double")
    side = F.when(F.col("before").isNotNull(), (F.signum(F.col("y_true") - F.col("before")) == F.signum(F.col("p") - F.col("before"))).cast("double"))
    a = x.groupBy("model").agg(
        F.avg(err).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE"), F.avg(same).alias("dir_acc"), F.avg(side).alias("turn_acc"),
        F.corr("y_true", "p").alias("corr"), F.avg(F.when(F.col("turn"), err)).alias("MAE_turns"), F.avg(F.when(F.col("turn"), side)).alias("turn_acc_turns"),
    )
    base = a.where(F.col("model") == benchmark).select(F.col("MAE").alias("base"))
    a = a.join(F.broadcast(base), how="left") if benchmark in [m.removeprefix("pred_") for m in models] else a.withColumn("base", F.lit(None).cast("double"))
    a = a.withColumn("skill_vs_AR", 1 - F.try_divide("MAE", F.nullif(F.col("base"), F.lit(0.0))))
    return a.select("model", "MAE", "RMSE", "skill_vs_AR", "dir_acc", "turn_acc", "corr", "MAE_turns", "turn_acc_turns").orderBy("MAE", "model")


def importance(gains: DataFrame, top: int = 20) -> DataFrame:
    """Shares of all gains and the family (text before the first '_') of the ``top`` features.

    ``gains`` is ``feature, gain``; shares are over every feature, also those that are cut off.
    """
    total = gains.agg(F.sum("gain").alias("total"))
    x = gains.join(F.broadcast(total), how="cross")
    share = F.try_divide("gain", F.nullif(F.col("total"), F.lit(0.0)))
    return x.select("feature", F.substring_index("feature", "_", 1).alias("family"), "gain", share.alias("share")).orderBy(F.desc("gain"), "feature").limit(top)
