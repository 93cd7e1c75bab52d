"""Patterns of failing sensors and gaps of calendars: each series in ranges of time, one row of counts for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import carried, running

#: Shortest flat stretch, deviations of a spike.
FLAT_SECONDS, SPIKE = 3600, 3.0


def _seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def flatlines(df: DataFrame, time: str, value: str, by: list[str], least_seconds: float = FLAT_SECONDS) -> DataFrame:
    """by columns, value, start, end and n of stretches in which a value does not move for at least so long; in ranges of time, so that no series is one task."""
    known = df.where(F.col(value).isNotNull()).select(*by, time, value)
    before = carried(known, time, {"__before": F.col(value)}, by, [value], current=False)
    moved = before.withColumn("__new", F.when(F.col(value).eqNullSafe(F.col("__before")), F.lit(0)).otherwise(F.lit(1))).drop("__before")
    stretches = running(moved, time, {"__k": F.col("__new")}, by, [value]).withColumn("__k", F.col("__k") + F.col("__new"))
    found = stretches.groupBy(*by, "__k").agg(F.first(value).alias(value), F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("__k")
    return found.where((F.col("n") > 1) & (_seconds("end") - _seconds("start") >= least_seconds))


def readings_report(df: DataFrame, time: str, value: str, by: list[str], deviations: float = SPIKE) -> DataFrame:
    """by columns and counts of spikes (beyond so many deviations of the series' mean), repeats of the time before, negative values and unknown ones."""
    rows = df.select(*by, F.col(time).alias("__t"), F.col(value).alias("__v"))
    moments = rows.groupBy(*[F.col(b).alias(f"__by_{i}") for i, b in enumerate(by)]).agg(F.avg("__v").alias("__mean"), F.stddev_samp("__v").alias("__sd"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{i}"))
    joined = rows.join(moments, same)
    times = joined.groupBy(*by, "__t").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.abs(F.col("__v") - F.col("__mean")) > deviations * F.col("__sd")).alias("__spikes"), F.count_if(F.col("__v") < 0).alias("__negative"), F.count_if(F.col("__v").isNull()).alias("__missing"))
    return times.groupBy(*by).agg(F.sum("__spikes").alias("n_spikes"), F.sum(F.col("__n") - 1).alias("n_stale"), F.sum("__negative").alias("n_negative"), F.sum("__missing").alias("n_missing"))


def calendar_gaps(df: DataFrame, time: str, by: list[str], step_seconds: float) -> DataFrame:
    """by columns, after and before: neighbouring distinct times of a series more than a step apart, and how many steps are missing."""
    times = df.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("before")).distinct()
    found = carried(times, "before", {"after": F.col("before")}, by, current=False).select(*by, "after", "before")
    steps = (_seconds("before") - _seconds("after")) / step_seconds
    return found.where(steps > 1).withColumn("n_missing", (F.ceil(steps) - 1).cast("long"))
