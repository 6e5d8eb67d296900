"""Drift of a stream against a fixed reference, one micro-batch after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import psi_report


def windowed_profile(stream: DataFrame, time: str, value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, n, mean, n_null) over event time; rows later than ``late`` are dropped."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", every)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.count_if(F.col(value).isNull()).alias("n_null"))


def monitor_psi(stream: DataFrame, reference: DataFrame, checkpoint: str, report: Callable[[int, DataFrame], None], columns: list[str] | None = None) -> StreamingQuery:
    """Start a query that passes each batch's PSI table to ``report`` with the batch's number."""
    fixed = reference.cache()

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            report(number, psi_report(fixed, batch, columns))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
