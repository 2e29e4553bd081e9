"""Telemetry gaps of a row group (or any group of samples)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_FACTOR = 5


def _intervals(samples: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return samples.withColumn("_prev", F.lag(ts).over(w)).withColumn("_dt", F.col(ts) - F.col("_prev"))


def gap_metadata(samples: DataFrame, keys: Sequence[str], ts: str = "timestamp_ns", threshold_ns: int | None = None) -> DataFrame:
    """keys, row_count, gap_count, max_gap_ns, max_gap_start_ts_ns, max_gap_end_ts_ns, nominal_dt_ns for each group.

    Times are sorted and only positive differences count. nominal_dt_ns is their median (of an even number, the rounded
    mean of the middle two; 0 without any). A gap is a difference strictly above max(1, threshold_ns or 5 times the
    nominal one); the largest, and of equal ones the first, is described (zeros without one).

    One shuffle: the window, both aggregates and the join are all partitioned by the keys.
    """
    keys = list(keys)
    steps = _intervals(samples.select(*keys, ts), keys, ts, [ts])
    counted = steps.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.round(F.percentile(F.when(F.col("_dt") > 0, F.col("_dt")), F.lit(0.5))).cast("long"), F.lit(0)).alias("nominal_dt_ns"),
    )
    limit = F.greatest(F.lit(1), F.lit(threshold_ns) if threshold_ns else GAP_FACTOR * F.col("nominal_dt_ns"))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    counted = counted.select(*named, "row_count", "nominal_dt_ns", limit.cast("long").alias("_limit"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = steps.join(counted, on)
    gap = (F.col("_dt") > 0) & (F.col("_dt") > F.col("_limit"))
    # max_by over (size, earlier first)
    best = F.max_by(F.struct("_dt", "_prev", F.col(ts).alias("_end")), F.when(gap, F.struct(F.col("_dt"), -F.col("_prev"))))
    found = joined.groupBy(*keys).agg(
        F.first("row_count").alias("row_count"), F.count_if(gap).alias("gap_count"), best.alias("_g"), F.first("nominal_dt_ns").alias("nominal_dt_ns")
    )
    got = lambda c: F.when(F.col("gap_count") > 0, F.col(c)).otherwise(F.lit(0)).cast("long")
    return found.select(
        *keys,
        "row_count",
        "gap_count",
        got("_g._dt").alias("max_gap_ns"),
        got("_g._prev").alias("max_gap_start_ts_ns"),
        got("_g._end").alias("max_gap_end_ts_ns"),
        "nominal_dt_ns",
    )


def sample_gap_stats(samples: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "timestamp_ns", threshold_ns: int | None = None) -> DataFrame:
    """keys, gap_count, max_interval_ns, nominal_dt_ns of samples in the order they were read.

    Unlike gap_metadata, nothing is sorted by time, and max_interval_ns is the largest difference even if it is no gap
    (a name of its own, since the two numbers differ).
    """
    keys = list(keys)
    steps = _intervals(samples, keys, ts, list(order))
    nominal = F.coalesce(F.round(F.percentile(F.when(F.col("_dt") > 0, F.col("_dt")), F.lit(0.5))).cast("long"), F.lit(0))
    # exact in one pass: the positive differences of a row group are few, so they are kept for the count
    diffs = F.collect_list(F.when(F.col("_dt") > 0, F.col("_dt")))
    got = steps.groupBy(*keys).agg(nominal.alias("nominal_dt_ns"), diffs.alias("_d"))
    limit = F.greatest(F.lit(1), F.lit(threshold_ns) if threshold_ns else GAP_FACTOR * F.col("nominal_dt_ns"))
    return got.select(
        *keys,
        F.size(F.filter("_d", lambda d: d > limit)).cast("long").alias("gap_count"),
        F.coalesce(F.array_max("_d"), F.lit(0)).cast("long").alias("max_interval_ns"),
        "nominal_dt_ns",
    )


def gaps_touch(start: Column, end: Column) -> Column:
    """Whether a catalog row's largest gap lies on the closed window."""
    return (F.col("gap_count") > 0) & (F.col("max_gap_end_ts_ns") >= start) & (F.col("max_gap_start_ts_ns") <= end)


def gap_summary(rows: DataFrame, keys: Sequence[str], start: Column, end: Column) -> DataFrame:
    """For each group of catalog rows: row groups with a gap in the window, their gaps, and the largest one (the first
    of equal ones)."""
    touch = gaps_touch(start, end)
    best = F.max_by(
        F.struct("max_gap_ns", "max_gap_start_ts_ns", "max_gap_end_ts_ns"),
        F.when(touch, F.struct(F.col("max_gap_ns"), -F.col("start_ts_ns"), -F.col("row_group_id"))),
    )
    out = rows.groupBy(*keys).agg(
        F.count_if(touch).alias("gap_row_groups"), F.coalesce(F.sum(F.when(touch, F.col("gap_count"))), F.lit(0)).alias("gap_count"), best.alias("_g")
    )
    has = F.col("gap_row_groups") > 0
    return out.select(
        *keys,
        "gap_row_groups",
        "gap_count",
        *(F.when(has, F.col(f"_g.{c}")).otherwise(F.lit(0)).cast("long").alias(c) for c in ("max_gap_ns", "max_gap_start_ts_ns", "max_gap_end_ts_ns")),
    )


def seam_gaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps between row groups that follow each other, which no row group sees inside itself: the time from the end of
    one to the start of the next, above GAP_FACTOR times the larger nominal step."""
    w = Window.partitionBy(*keys).orderBy("start_ts_ns", "row_group_id")
    before = rows.withColumn("_end", F.lag("end_ts_ns").over(w)).withColumn("_dt", F.lag("nominal_dt_ns").over(w))
    limit = GAP_FACTOR * F.greatest("_dt", "nominal_dt_ns")
    return before.where((limit > 0) & (F.col("start_ts_ns") - F.col("_end") > limit)).select(
        *keys, "row_group_id", F.col("_end").alias("gap_start_ts_ns"), F.col("start_ts_ns").alias("gap_end_ts_ns")
    )
