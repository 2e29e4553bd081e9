"""Readers of robot datasets: EuRoC (folders and zips), KITTI OXTS and nuScenes ego poses, as managed tables."""

from __future__ import annotations

import os
import posixpath
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.motion import mercator, rpy_to_quat, velocity_magnitude
from ..functions.times import datetime_text_to_ns
from ..operators.motion import velocity_central
from ..schemas import CAMERA_SCHEMA, IMU_SCHEMA, POSE_SCHEMA, typed


def _named(df: DataFrame, robot_id: str, session_id: str) -> DataFrame:
    return df.withColumns({"robot_id": F.lit(robot_id), "session_id": F.lit(session_id)})


def _with_speed(df: DataFrame) -> DataFrame:
    return df.withColumn("velocity", velocity_magnitude(F.col("vx"), F.col("vy"), F.col("vz")))


def zip_members(path: str, suffix: str) -> list[str]:
    """Members of a zip, or of the first zip in a folder, whose names end in suffix."""
    with zipfile.ZipFile(first_zip(path)) as z:
        return sorted(n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/"))


def first_zip(path: str) -> str:
    if os.path.isdir(path):
        found = sorted(f for f in os.listdir(path) if f.endswith(".zip"))
        if not found:
            raise FileNotFoundError(f"no zip in {path}")
        return os.path.join(path, found[0])
    return path


def _rows(lines: DataFrame, least: int, exact: bool = False, what: str = "row") -> Column:
    """Trimmed comma-separated fields of each line; too few (or another number, with exact) raise."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    ok = F.size(f) == least if exact else F.size(f) >= least
    return F.when(ok, f).otherwise(F.raise_error(F.concat(F.lit(f"{what} without {least} columns: "), F.col("value"))).cast("array<string>"))


def _lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Lines of a text file, or of a member of a zip, without comments and blanks. A zip is read where it is listed:
    one task for a member."""
    if path.endswith(".zip"):

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with zipfile.ZipFile(path) as z, z.open(name) as f:
                        held = []
                        for line in f:
                            held.append(line.decode("utf-8").rstrip("\r\n"))
                            if len(held) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                                held = []
                        if held:
                            yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])

        text = spark.createDataFrame([(member,)], "member string").mapInArrow(run, "value string")
    else:
        text = spark.read.text(posixpath.join(path, member) if member else path)
    return text.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))


#: Where EuRoC keeps each stream, below the dataset's root.
EUROC = {"pose": "mav0/state_groundtruth_estimate0/data.csv", "imu": "mav0/imu0/data.csv"}


def euroc_groundtruth(spark: SparkSession, path: str, robot_id: str = "euroc_mav", session_id: str = "session_001", member: str = EUROC["pose"]) -> DataFrame:
    """Poses of a ground-truth CSV: time, position, quaternion w first, velocity; further columns are ignored."""
    f = _rows(_lines(spark, path, member), 11, what="ground truth")
    names = ("x", "y", "z", "qw", "qx", "qy", "qz", "vx", "vy", "vz")
    rows = _lines(spark, path, member).select(f.alias("f"))
    rows = rows.select(F.col("f")[0].cast("long").alias("timestamp_ns"), *(F.col("f")[k + 1].cast("double").alias(n) for k, n in enumerate(names)))
    return typed(_with_speed(_named(rows, robot_id, session_id)), POSE_SCHEMA)


def euroc_imu(spark: SparkSession, path: str, robot_id: str = "euroc_mav", session_id: str = "session_001", member: str = EUROC["imu"]) -> DataFrame:
    """Inertial samples: exactly seven columns, gyroscope before accelerometer."""
    lines = _lines(spark, path, member)
    rows = lines.select(_rows(lines, 7, exact=True, what="IMU row").alias("f"))
    names = ("gx", "gy", "gz", "ax", "ay", "az")
    rows = rows.select(F.col("f")[0].cast("long").alias("timestamp_ns"), *(F.col("f")[k + 1].cast("double").alias(n) for k, n in enumerate(names)))
    return typed(_named(rows, robot_id, session_id), IMU_SCHEMA)


def frame_member(stream: str, name: str) -> str:
    """Where a frame of a camera's index lies below the root: as named if from mav0 on, else in the camera's data folder."""
    if name.startswith("mav0/"):
        return name
    return f"mav0/{stream}/{name}" if name.startswith("data/") else f"mav0/{stream}/data/{name}"


def euroc_camera(spark: SparkSession, path: str, stream: str = "cam0", robot_id: str = "euroc_mav", session_id: str = "session_001") -> DataFrame:
    """Frames of a camera: its index joined with the images' bytes."""
    lines = _lines(spark, path, f"mav0/{stream}/data.csv")
    f = _rows(lines, 2, what="camera row")
    name = F.col("f")[1]
    member = F.when(name.startswith("mav0/"), name).when(name.startswith("data/"), F.concat(F.lit(f"mav0/{stream}/"), name)).otherwise(F.concat(F.lit(f"mav0/{stream}/data/"), name))
    index = lines.select(f.alias("f")).select(F.col("f")[0].cast("long").alias("timestamp_ns"), member.alias("frame_path"))
    if path.endswith(".zip"):

        def run(batches):
            import pyarrow as pa

            with zipfile.ZipFile(path) as z:
                for batch in batches:
                    for a in range(0, batch.num_rows, 32):
                        part = batch.slice(a, 32)
                        data = pa.array([z.read(n) for n in part.column(1).to_pylist()], pa.binary())
                        yield pa.RecordBatch.from_arrays([*part.columns, data], ["timestamp_ns", "frame_path", "camera_bytes"])

        rows = index.mapInArrow(run, "timestamp_ns long, frame_path string, camera_bytes binary")
    else:
        files = spark.read.format("binaryFile").load(f"{path}/mav0/{stream}/data/*").select("path", "content")
        files = files.select(F.concat(F.lit(f"mav0/{stream}/data/"), F.element_at(F.split("path", "/"), -1)).alias("frame_path"), F.col("content").alias("camera_bytes"))
        rows = index.join(files, "frame_path", "left")
    return typed(_named(rows, robot_id, session_id).withColumn("stream_id", F.lit(stream)), CAMERA_SCHEMA)


def kitti_oxts(spark: SparkSession, path: str, robot_id: str = "kitti_vehicle", session_id: str = "session_001") -> DataFrame:
    """Poses of OXTS packets: Mercator metres relative to the first packet, roll-pitch-yaw as a quaternion, velocity
    (east, north, up). timestamps.txt is zipped on by place and must have a line for each packet; without it the packet
    number is the time."""
    root = path if os.path.isdir(f"{path}/data") else f"{path}/oxts"
    packets = spark.read.text(f"{root}/data/*.txt", wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    f = F.split(F.trim("value"), r"\s+")
    ok = F.when(F.size(f) >= 30, f).otherwise(F.raise_error(F.concat(F.lit("OXTS packet without 30 fields: "), F.col("file"))).cast("array<string>"))
    rows = packets.select("file", ok.alias("f"))
    names = {"lat": 0, "lon": 1, "alt": 2, "roll": 3, "pitch": 4, "yaw": 5, "vn": 6, "ve": 7, "vu": 10}
    rows = rows.select("file", *(F.col("f")[k].cast("double").alias(n) for n, k in names.items()))
    rows = rows.withColumn("n", F.row_number().over(Window.orderBy("file")) - 1)  # a drive's packets are files of one folder
    if os.path.isfile(f"{root}/timestamps.txt"):
        with open(f"{root}/timestamps.txt", encoding="utf-8") as file:
            stamps = [(i, line.strip()) for i, line in enumerate(x for x in file if x.strip())]
        if len(stamps) != packets.count():
            raise ValueError(f"timestamps.txt has {len(stamps)} lines for {packets.count()} packets")
        times = spark.createDataFrame(stamps, "n int, stamp string").select("n", datetime_text_to_ns(F.col("stamp")).alias("timestamp_ns"))
        rows = rows.join(times, "n")
    else:
        rows = rows.withColumn("timestamp_ns", F.col("n").cast("long"))
    first = rows.agg(*(F.min_by(c, "n").alias(f"{c}0") for c in ("lat", "lon", "alt")))
    rows = rows.crossJoin(F.broadcast(first))
    east, north = mercator(F.col("lat"), F.col("lon"), F.col("lat0"))
    east0, north0 = mercator(F.col("lat0"), F.col("lon0"), F.col("lat0"))
    q = rpy_to_quat(F.col("roll"), F.col("pitch"), F.col("yaw"))
    out = rows.withColumns(
        {
            "x": east - east0, "y": north - north0, "z": F.col("alt") - F.col("alt0"),
            **{f"q{a}": c for a, c in zip("wxyz", q, strict=True)}, "vx": F.col("ve"), "vy": F.col("vn"), "vz": F.col("vu"),
        }
    )
    return typed(_with_speed(_named(out, robot_id, session_id)), POSE_SCHEMA)


def nuscenes_file(path: str) -> str:
    """ego_pose.json in the folder itself, or in its v1.0-mini or v1.0-trainval."""
    for sub in ("", "v1.0-mini", "v1.0-trainval"):
        candidate = os.path.join(path, sub, "ego_pose.json")
        if os.path.isfile(candidate):
            return candidate
    if path.endswith(".json"):
        return path
    raise FileNotFoundError(f"no ego_pose.json under {path}")


def nuscenes_ego(spark: SparkSession, path: str, robot_id: str = "nuscenes_ego", session_id: str = "session_001") -> DataFrame:
    """Ego poses: microseconds to nanoseconds, translation, rotation w first, velocity by central differences."""
    raw = spark.read.schema("timestamp long, translation array<double>, rotation array<double>").json(nuscenes_file(path), multiLine=True)
    part = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.raise_error(F.lit(f"ego pose with a short {c}")).cast("double"))
    rows = raw.select(
        (F.col("timestamp") * 1000).alias("timestamp_ns"),
        *(part("translation", k).alias(a) for k, a in enumerate("xyz")),
        *(part("rotation", k).alias(f"q{a}") for k, a in enumerate("wxyz")),
    )
    return typed(_with_speed(velocity_central(_named(rows, robot_id, session_id))), POSE_SCHEMA)
