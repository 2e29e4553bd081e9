"""Velocities and consecutive-sample checks by window functions, partitioned by robot and session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.motion import quat_dot, quat_norm

KEYS = ("robot_id", "session_id")
NS = 1e9


def _window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def velocity_central(poses: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("timestamp_ns",), axes: str = "xyz") -> DataFrame:
    """v<axis> columns: central difference inside, one-sided at the ends, 0 where no time passes or there is one sample."""
    w = _window(keys, order)
    before, after = F.lag("timestamp_ns").over(w), F.lead("timestamp_ns").over(w)
    out = poses.withColumn("_dt", (F.coalesce(after, F.col("timestamp_ns")) - F.coalesce(before, F.col("timestamp_ns"))) / F.lit(NS))
    for a in axes:
        d = F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a))
        out = out.withColumn(f"v{a}", F.when(F.col("_dt") > 0, d / F.when(F.col("_dt") > 0, F.col("_dt"))).otherwise(F.lit(0.0)))
    return out.drop("_dt")


def velocity_backward(poses: DataFrame, given: Sequence[str] = (), keys: Sequence[str] = KEYS, order: Sequence[str] = ("timestamp_ns",), axes: str = "xyz") -> DataFrame:
    """v<axis>: the given column where it has a value, else the backward difference, else the forward one, else 0."""
    w = _window(keys, order)
    ts = F.col("timestamp_ns")
    out = poses
    back, ahead = (ts - F.lag(ts).over(w)) / F.lit(NS), (F.lead(ts).over(w) - ts) / F.lit(NS)
    for i, a in enumerate(axes):
        b = F.when(back > 0, (F.col(a) - F.lag(a).over(w)) / F.when(back > 0, back))
        f = F.when(ahead > 0, (F.lead(a).over(w) - F.col(a)) / F.when(ahead > 0, ahead))
        first: list[Column] = [F.col(given[i]).cast("double")] if len(given) > i and given[i] else []
        out = out.withColumn(f"_v{a}", F.coalesce(*first, b, f, F.lit(0.0)))
    for a in axes:
        out = out.drop(f"v{a}").withColumnRenamed(f"_v{a}", f"v{a}")
    return out


def time_violations(samples: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("timestamp_ns",)) -> DataFrame:
    """keys, violations: samples whose time is not after the one before in the given order."""
    w = _window(keys, order)
    marked = samples.withColumn("_p", F.lag("timestamp_ns").over(w))
    return marked.groupBy(*keys).agg(F.count_if(F.col("_p").isNotNull() & (F.col("timestamp_ns") <= F.col("_p"))).alias("violations"))


def quaternion_inversions(samples: DataFrame, quat: Sequence[str] = ("qw", "qx", "qy", "qz"), keys: Sequence[str] = KEYS, order: Sequence[str] = ("timestamp_ns",), digits: int | None = None) -> DataFrame:
    """keys, inversions: neighbours whose quaternions point into opposite halves; digits: products are rounded first."""
    w = _window(keys, order)
    dot = quat_dot([F.lag(c).over(w) for c in quat], [F.col(c) for c in quat])
    return samples.withColumn("_d", dot if digits is None else F.round(dot, digits)).groupBy(*keys).agg(F.count_if(F.col("_d") < 0).alias("inversions"))


def norm_errors(samples: DataFrame, keys: Sequence[str], quat: Sequence[str] = ("qw", "qx", "qy", "qz"), tolerance: float = 1e-3) -> DataFrame:
    """keys, off_norm: quaternions whose norm is off by more than the tolerance; worst: the largest error."""
    error = F.abs(quat_norm([F.col(c) for c in quat]) - 1)
    return samples.groupBy(*keys).agg(F.count_if(error > tolerance).alias("off_norm"), F.max(error).alias("worst"))


def speed_errors(samples: DataFrame, keys: Sequence[str], max_velocity: float, speed: str = "velocity") -> DataFrame:
    """keys, max_velocity, too_fast: samples above the limit; not_finite: those whose speed is no finite number."""
    v = F.col(speed)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return samples.groupBy(*keys).agg(F.max(v).alias("max_velocity"), F.count_if(v > max_velocity).alias("too_fast"), F.count_if(bad).alias("not_finite"))
