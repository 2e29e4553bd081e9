"""Managed Parquet tables, tensors as .npy files, and atomic output folders."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..schemas import CAMERA_SCHEMA, IMU_SCHEMA, POSE_SCHEMA, no_nulls

#: Rows of a row group by source, as a rule.
ROW_GROUP_ROWS = {"pose": 500, "imu": 2000, "camera": 20, "default": 100}


def write_managed(df: DataFrame, schema: StructType, path: str, row_group_rows: int = 100, one_file: bool = True) -> None:
    """df as a managed table: rows in order of time, row groups of row_group_rows rows.

    With one_file, the folder has one file (a session's stream is one file); else as many as there are sessions' worth
    of partitions, each sorted.
    """
    if row_group_rows < 1:
        raise ValueError("row_group_rows must be at least 1")
    out = no_nulls(df, schema)
    out = out.coalesce(1) if one_file else out.repartition("robot_id", "session_id")
    keys = ["timestamp_ns"] if one_file else ["robot_id", "session_id", "timestamp_ns"]
    (
        out.sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("parquet.block.row.count.limit", row_group_rows)
        .option("parquet.page.row.count.limit", max(1, min(row_group_rows, 20_000)))
        .parquet(path)
    )


def write_pose(df: DataFrame, path: str, row_group_rows: int = 100, **more) -> None:
    write_managed(df, POSE_SCHEMA, path, row_group_rows, **more)


def write_imu(df: DataFrame, path: str, row_group_rows: int = 100, **more) -> None:
    write_managed(df, IMU_SCHEMA, path, row_group_rows, **more)


def write_camera(df: DataFrame, path: str, row_group_rows: int = 20, **more) -> None:
    write_managed(df, CAMERA_SCHEMA, path, row_group_rows, **more)


def parquet_files(folder: str) -> list[str]:
    """The data files of a local table, or the file itself."""
    if os.path.isfile(folder):
        return [folder]
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet"))


def write_npy(prefix: str, values: np.ndarray, timestamps_ns: np.ndarray) -> tuple[str, str]:
    """<prefix>.values.npy (float64) and <prefix>.timestamps_ns.npy (int64)."""
    names = f"{prefix}.values.npy", f"{prefix}.timestamps_ns.npy"
    np.save(names[0], np.ascontiguousarray(values, np.float64))
    np.save(names[1], np.ascontiguousarray(timestamps_ns, np.int64))
    return names


def read_npy_timestamps(path: str) -> np.ndarray:
    got = np.load(path, allow_pickle=False)
    if got.dtype != np.dtype("<i8") or got.ndim != 1:
        raise ValueError("timestamps must be one-dimensional little-endian int64")
    return got


@contextmanager
def atomic_folder(root: str) -> Iterator[str]:
    """A folder beside root to write into; it becomes root on success and goes without a trace otherwise. Root must not
    hold anything yet."""
    root = os.path.abspath(root)
    if os.path.exists(root) and (not os.path.isdir(root) or os.listdir(root)):
        raise FileExistsError(f"{root} is not empty")
    temporary = os.path.join(os.path.dirname(root), f".{os.path.basename(root)}.tmp-{uuid.uuid4().hex}")
    os.makedirs(temporary)
    try:
        yield temporary
        if os.path.isdir(root):
            os.rmdir(root)
        os.rename(temporary, root)
    except BaseException:
        shutil.rmtree(temporary, ignore_errors=True)
        raise
