"""Event-time windows, joins and repeats, for streams and tables alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks reject times without a zone
    return rows.withWatermark(time, late) if events.isStreaming else rows


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Start, keys, n and total of each window; sliding windows with slide."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = _timed(events, time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Start, end, keys and n of each session: runs of a key's events less than gap apart."""
    out = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def joined(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of equal keys whose right time is at or after the left one, and within so long of it.

    For streams both sides have a watermark, and the condition bounds how long a row is
    kept for partners to come: state is dropped within and late after its time. A row
    that comes later than that is left out. Time columns must have different names.
    """
    a, b = _timed(left, left_time, late), _timed(right, right_time, late)
    named = {k: f"__{k}" for k in keys}
    b = b.withColumnsRenamed(named)
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(n) for k, n in named.items()])
    span = F.expr(f"INTERVAL {within}")
    pairs = a.join(b, same & (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + span))
    return pairs.drop(*named.values())


def distinct_events(events: DataFrame, ids: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """One row of each id; of a stream the first to come, repeats being known for at least as long as rows may be late."""
    rows = _timed(events, time, late)
    return rows.dropDuplicatesWithinWatermark(ids) if events.isStreaming else rows.dropDuplicates(ids)


def stream_to_table(events: DataFrame, query: str, path: str, checkpoint: str):
    """Run a streaming frame into parquet; the checkpoint folder lets it go on where it stopped."""
    return events.writeStream.queryName(query).format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
