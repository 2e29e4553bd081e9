"""Tables and image folders of any make, mapped onto managed tables."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.motion import velocity_magnitude
from ..functions.times import filename_digits, filename_digits_of, scaled
from ..operators.motion import velocity_backward
from ..schemas import CAMERA_SCHEMA, IMU_CHANNELS, IMU_SCHEMA, POSE_SCHEMA, typed

#: Image files that a folder of frames may hold.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")


def relation(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (header, inferred types) or Parquet table."""
    if str(path).lower().endswith((".csv", ".csv.gz", ".txt")):
        return spark.read.csv(str(path), header=True, inferSchema=True)
    return spark.read.parquet(str(path))


def no_number(value: Column) -> Column:
    """Whether a value is no number, a null included."""
    return value.cast("string").try_cast("double").isNull()


def bad_numbers(df: DataFrame, column: str) -> int:
    """Rows whose value is no number."""
    return df.agg(F.count_if(no_number(F.col(f"`{column}`")))).collect()[0][0]


def _number(column: str | None) -> Column:
    return F.col(f"`{column}`").cast("double") if column else F.lit(None).cast("double")


def _times(df: DataFrame, column: str, scale: float) -> Column:
    return scaled(F.col(f"`{column}`"), scale, isinstance(df.schema[column].dataType, IntegralType))


def pose_table(df: DataFrame, mapping: Mapping[str, str], scale: float, robot_id: str, session_id: str) -> DataFrame:
    """Managed poses from mapped columns (timestamp, x, y, z, qw ... and, if there are any, vx, vy, vz). A velocity that
    is not mapped, or null, is derived by differences."""
    need = ("x", "y", "z", "qw", "qx", "qy", "qz")
    missing = [n for n in ("timestamp", *need) if not mapping.get(n)]
    if missing:
        raise ValueError(f"the mapping lacks {', '.join(missing)}")
    rows = df.select(
        _times(df, mapping["timestamp"], scale).alias("timestamp_ns"),
        F.lit(robot_id).alias("robot_id"),
        F.lit(session_id).alias("session_id"),
        *(_number(mapping[n]).alias(n) for n in need),
        *(_number(mapping.get(n)).alias(f"in_{n}") for n in ("vx", "vy", "vz")),
    )
    out = velocity_backward(rows, ("in_vx", "in_vy", "in_vz"))
    return typed(out.withColumn("velocity", velocity_magnitude(F.col("vx"), F.col("vy"), F.col("vz"))), POSE_SCHEMA)


def imu_table(df: DataFrame, mapping: Mapping[str, str], scale: float, robot_id: str, session_id: str) -> DataFrame:
    missing = [n for n in ("timestamp", *IMU_CHANNELS) if not mapping.get(n)]
    if missing:
        raise ValueError(f"the mapping lacks {', '.join(missing)}")
    rows = df.select(
        _times(df, mapping["timestamp"], scale).alias("timestamp_ns"),
        F.lit(robot_id).alias("robot_id"),
        F.lit(session_id).alias("session_id"),
        *(_number(mapping[n]).alias(n) for n in IMU_CHANNELS),
    )
    return typed(rows, IMU_SCHEMA)


def image_files(path: str) -> list[str]:
    """Images below a local folder, in order of name."""
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith(IMAGE_SUFFIXES)]
    return sorted(found)


def unnamed_images(path: str) -> list[str]:
    """Images whose names hold no time (fewer than six digits)."""
    return [f for f in image_files(path) if filename_digits_of(f) is None]


def image_table(spark: SparkSession, path: str, stream_id: str, scale: float, robot_id: str, session_id: str) -> DataFrame:
    """Managed frames of an image folder: the digits of a file's name are its time, in units of scale ns."""
    glob = "*{" + ",".join(sorted({s for x in IMAGE_SUFFIXES for s in (x, x.upper())})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    digits = F.coalesce(filename_digits(F.col("path")), F.raise_error(F.concat(F.lit("no time in the name of "), F.col("path"))).cast("long"))
    rows = files.select(
        scaled(digits, scale, True).alias("timestamp_ns"),
        F.lit(robot_id).alias("robot_id"),
        F.lit(session_id).alias("session_id"),
        F.lit(stream_id).alias("stream_id"),
        F.element_at(F.split("path", "/"), -1).alias("frame_path"),
        F.col("content").alias("camera_bytes"),
    )
    return typed(rows, CAMERA_SCHEMA)
