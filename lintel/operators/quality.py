"""Calibration and key checks (Q1, Q2) and the debt trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.scan import cut_by_rows, segmented_running


def calibration(metrics: DataFrame, expectations: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Q1: expected vs actual cognitive complexity and hours per file."""
    j = expectations.join(
        metrics.select("file_path", F.col("cognitive_complexity").alias("actual_cognitive"),
                       F.col("sqale_debt_hours").alias("actual_hours")), "file_path", "left")
    ok_c = F.col("actual_cognitive") == F.col("cognitive_complexity")
    ok_h = F.abs(F.col("actual_hours") - F.col("sqale_debt_hours")) < tolerance
    return j.select(
        "file_path", F.col("cognitive_complexity").alias("expected_cognitive"), "actual_cognitive",
        F.col("sqale_debt_hours").alias("expected_hours"), "actual_hours",
        F.coalesce(ok_c & ok_h, F.lit(False)).alias("passed"),
    )


def calibration_summary(checks: DataFrame) -> DataFrame:
    """Q1 overall: files, passed files, all passed."""
    return checks.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("passed").alias("passed_files"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"),
    )


def duplicate_keys(df: DataFrame, key: str = "file_path") -> DataFrame:
    """Q2: keys present more than once (empty when the key is unique)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def debt_trend(history: DataFrame, key: str = "file_path", ts: str = "last_analyzed",
               seq: str = "seq", value: str = "sqale_debt_hours") -> DataFrame:
    """Per file, the change against the previous snapshot and the
    running total, in (ts, seq) order. The history is cut by rows, so a
    file or a day with most of them is spread like the rest."""
    cut = cut_by_rows(history, [key], [ts, seq])
    x = segmented_running(cut, [key], [ts, seq], value, F.col("__cut"), out="running_value", prev_out="previous_value").drop("__cut")
    return x.withColumn("delta", F.col(value) - F.col("previous_value"))
