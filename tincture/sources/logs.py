"""Run logs as CSV, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WL_LOG = "step int, feature_dim long, n_colors long, calculation_time_in_seconds double"
QSC_LOG = "step int, feature_dim long, max_q_error double, partition_count long, witness_pair_count long, calculation_time_in_seconds double"
CV_LOG = "trial int, fold int, C double, param int, accuracy double"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).csv(path, header=True)
