"""Cross-validation results to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .formats import percent, two_decimals


def parameter_frequency(test: DataFrame) -> DataFrame:
    """(param, n, share) of the parameters chosen by the outer folds."""
    return test.groupBy("param").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def per_trial(test: DataFrame) -> DataFrame:
    return test.groupBy("trial").agg(F.avg("accuracy").alias("accuracy"))


def summary(test: DataFrame) -> DataFrame:
    """(mean, std): mean and sample standard deviation of the trials' means."""
    return per_trial(test).agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"))


def inner_accuracy(train: DataFrame) -> DataFrame:
    """(trial, fold, param, C, accuracy): mean over inner folds."""
    return train.groupBy("trial", "fold", "param", "C").agg(F.avg("accuracy").alias("accuracy"))


def best_parameters(scores: DataFrame, params: list[int], costs: list[float]) -> DataFrame:
    """For each (trial, fold) the first strict maximum in the order of the grids: parameters outside, costs inside."""
    place = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    rank = F.row_number().over(Window.partitionBy("trial", "fold").orderBy(F.desc("accuracy"), place(params, "param"), place(costs, "C")))
    return scores.withColumn("_r", rank).where("_r = 1").drop("_r")


def report_lines(test: DataFrame) -> list[str]:
    frequency = parameter_frequency(test).select("param", F.concat(F.lit("param="), F.col("param").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" ("), percent(F.col("share")), F.lit(")")).alias("line"))
    trials = per_trial(test).select("trial", F.concat(F.lit("trial "), F.col("trial").cast("string"), F.lit(": "), two_decimals(F.col("accuracy"))).alias("line"))
    total = summary(test).select(two_decimals(F.col("mean")).alias("mean"), F.coalesce(two_decimals(F.col("std")), F.lit("nan")).alias("std")).first()
    return [
        "# Parameter Frequency", *(r["line"] for r in frequency.orderBy("param").collect()),
        "", "# Per-Trial Accuracy Averages", *(r["line"] for r in trials.orderBy("trial").collect()),
        "", "# Summary", f"Average of trial averages: {total['mean']}", f"Standard deviation of averages: {total['std']}",
    ]
