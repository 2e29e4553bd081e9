"""Incremental catalogs: pose samples that arrive as a stream, indexed window by window (an extension of ours).

Samples are watermarked by event time and grouped by robot, session and a tumbling window; each closed window is a
virtual row group with the catalog's statistics. Only built-in streaming aggregates are used. State holds a few numbers
and, for gap metadata, every sample time (8 bytes) of the open windows: their length times the rate, for each session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gaps import GAP_FACTOR


def stream_catalog(poses: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """A row for each robot, session and window of the stream of managed pose rows, once the watermark has passed it.

    Rows must arrive within `late` of the newest before them; later ones are dropped, as watermarks do, and counted (see
    late_rows). Files of a backlog should be read in the order of their times: a file source takes them by modification
    time, so one that is late by more than `late` loses rows. Times are exact BIGINT nanoseconds; the
    event time in microseconds only decides on the window.
    """
    timed = poses.withColumn("event_time", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("event_time", late)
    stats = [f(c).alias(f"{n}_{c}") for c in ("x", "y", "z", "velocity") for n, f in (("min", F.min), ("max", F.max))]
    grouped = timed.groupBy("robot_id", "session_id", F.window("event_time", window)).agg(
        F.min("timestamp_ns").alias("start_ts_ns"),
        F.max("timestamp_ns").alias("end_ts_ns"),
        *stats,
        F.count("*").alias("row_count"),
        F.array_sort(F.collect_list("timestamp_ns")).alias("_t"),
    )
    steps = F.filter(F.transform(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda t, i: t - F.get("_t", i)), lambda d: d > 0)
    out = grouped.withColumn("_d", F.array_sort(steps))
    n = F.size("_d")
    odd, low, high = F.get("_d", F.expr("size(_d) div 2")), F.get("_d", F.expr("size(_d) div 2 - 1")), F.get("_d", F.expr("size(_d) div 2"))
    nominal = F.when(n == 0, 0).when(n % 2 == 1, odd).otherwise(F.floor((low + high + 1) / 2)).cast("long")
    out = out.withColumn("nominal_dt_ns", nominal)
    limit = F.greatest(F.lit(1), GAP_FACTOR * F.col("nominal_dt_ns"))
    gaps = F.filter("_d", lambda d: d > limit)
    return out.withColumn("gap_count", F.size(gaps).cast("long")).withColumn("max_gap_ns", F.coalesce(F.array_max(gaps), F.lit(0)).cast("long")).drop("_t", "_d", "window")


def late_rows(query) -> int:
    """How many rows a streaming query has dropped because they came behind the watermark, by the progress it still keeps."""
    return sum(int(state.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for state in p["stateOperators"])
