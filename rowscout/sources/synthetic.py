"""Synthetic pose sessions: a straight run along x with a sine in y."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.motion import velocity_magnitude
from ..functions.times import grid_step
from ..schemas import POSE_SCHEMA, typed


def synthetic_pose(
    spark: SparkSession, hz: float = 100.0, duration_s: float = 1.0, start_ts_ns: int = 0, robot_id: str = "robot_01", session_id: str = "session_001"
) -> DataFrame:
    """Samples from the start to start + duration, both included: x = 2 s, y = sin(2 pi s), identity rotation."""
    step = grid_step(hz)
    count = int(duration_s * 1e9) // step + 1
    s = F.col("id") * step / F.lit(1e9)
    turn = 2 * math.pi * s
    cols = {
        "timestamp_ns": F.col("id") * step + start_ts_ns,
        "robot_id": F.lit(robot_id),
        "session_id": F.lit(session_id),
        "x": 2 * s, "y": F.sin(turn), "z": F.lit(0.0),
        "qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0),
        "vx": F.lit(2.0), "vy": F.cos(turn), "vz": F.lit(0.0),
    }
    out = spark.range(count).select(*(c.alias(n) for n, c in cols.items()))
    return typed(out.withColumn("velocity", velocity_magnitude(F.col("vx"), F.col("vy"), F.col("vz"))), POSE_SCHEMA)
