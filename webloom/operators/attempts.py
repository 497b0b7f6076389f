"""Retries over a log of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retry_outcome(attempts: DataFrame, max_retries: int) -> DataFrame:
    """Per URL: attempts used, the first success among the first ``max_retries``, and whether they ran out.

    ``attempts(url, ts, attempt_id, ok)``. The row-number filter becomes a group limit before the exchange, so
    one URL with most of the log sends at most ``max_retries`` rows per task.
    """
    first = Window.partitionBy("url").orderBy("ts", "attempt_id")
    tried = attempts.withColumn("attempt", F.row_number().over(first)).filter(F.col("attempt") <= max_retries)
    success = F.min(F.when(F.col("ok"), F.col("attempt")))
    return tried.groupBy("url").agg(
        F.coalesce(success, F.max("attempt")).cast("bigint").alias("attempts"),
        success.cast("bigint").alias("first_success"),
        (success.isNull() & (F.max("attempt") >= max_retries)).alias("exhausted"),
    )
