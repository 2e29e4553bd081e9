"""Schemas of managed tables and catalogs, and the channel vocabulary. Times are BIGINT nanoseconds throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _fields(kind, names: str, null: bool = False) -> list[StructField]:
    return [StructField(n, kind, null) for n in names.split()]


_KEYS = [StructField("timestamp_ns", LongType(), False), *_fields(StringType(), "robot_id session_id")]
POSE_SCHEMA = StructType(_KEYS + _fields(DoubleType(), "x y z qw qx qy qz vx vy vz velocity"))
IMU_SCHEMA = StructType(_KEYS + _fields(DoubleType(), "ax ay az gx gy gz"))
CAMERA_SCHEMA = StructType(_KEYS + _fields(StringType(), "stream_id frame_path") + [StructField("camera_bytes", BinaryType(), False)])

_GAPS = "max_gap_ns max_gap_start_ts_ns max_gap_end_ts_ns nominal_dt_ns"


def _catalog(ranges: str) -> StructType:
    return StructType(
        _fields(StringType(), "robot_id session_id file_uri")
        + [StructField("row_group_id", IntegerType(), False)]
        + _fields(LongType(), "start_ts_ns end_ts_ns")
        + _fields(DoubleType(), ranges)
        + _fields(LongType(), f"byte_offset byte_length row_count gap_count {_GAPS}")
    )


def _min_max(names: str) -> str:
    return " ".join(f"min_{n} max_{n}" for n in names.split())


POSE_CATALOG_SCHEMA = _catalog(_min_max("x y z velocity"))
IMU_CATALOG_SCHEMA = _catalog(_min_max("ax ay az gx gy gz"))
MEDIA_CATALOG_SCHEMA = StructType(
    _fields(StringType(), "robot_id session_id file_uri modality stream_id")
    + [StructField("row_group_id", IntegerType(), False)]
    + _fields(LongType(), "start_ts_ns end_ts_ns byte_offset byte_length row_count")
    + _fields(DoubleType(), _min_max("x y z"), null=True)
)

POSE_CHANNELS = ("x", "y", "z", "qw", "qx", "qy", "qz", "vx", "vy", "vz")
IMU_CHANNELS = ("ax", "ay", "az", "gx", "gy", "gz")
#: Query channels, with the tensor columns, unit and frame of each.
CHANNELS = {
    "pos_xyz": (("x", "y", "z"), "m", "world"),
    "rot_wxyz": (("qw", "qx", "qy", "qz"), "1", "world"),
    "vel_xyz": (("vx", "vy", "vz"), "m/s", "world"),
    "imu_accel": (("ax", "ay", "az"), "m/s^2", "imu"),
    "imu_gyro": (("gx", "gy", "gz"), "rad/s", "imu"),
}
MEDIA_PREFIXES = ("camera", "lidar")


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns, cast to its types, and nothing else; a missing column is an error.

    Parquet's unsigned 32- and 64-bit integers arrive as BIGINT and DECIMAL(20, 0) and are cast like the rest.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def no_nulls(df: DataFrame, schema: StructType) -> DataFrame:
    """df as the schema has it; reading a row with a null in a column that must not be null raises."""
    df = typed(df, schema)
    return df.select(
        *(
            F.col(f.name)
            if f.nullable
            else F.coalesce(f.name, F.raise_error(F.lit(f"null in column {f.name}")).cast(f.dataType)).alias(f.name)
            for f in schema
        )
    )
