"""A small export with column names that no alias knows, and its way to a tensor."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..plans.query import query_managed_dataset
from .adapters import ingest_manifest, inspect_dataset, suggest_manifest

ROWS, START, STEP = 30, 5_000_000, 50_000  # microseconds: 30 rows at 20 Hz
CLOCK = "tick_us"
POSE = {
    "x": "floor_a", "y": "floor_b", "z": "lift", "qw": "turn_0", "qx": "turn_1", "qy": "turn_2", "qz": "turn_3",
    "vx": "drift_a", "vy": "drift_b", "vz": "climb",
}
IMU = {"ax": "push_a", "ay": "push_b", "az": "push_c", "gx": "spin_a", "gy": "spin_b", "gz": "spin_c"}


def write_messy(root: str) -> None:
    """Pose and inertial CSVs of ROWS rows, and an image every fifth row."""
    frames = os.path.join(root, "mast_images")
    os.makedirs(frames, exist_ok=True)
    times = [START + i * STEP for i in range(ROWS)]
    with open(os.path.join(root, "warehouse_walk.csv"), "w", encoding="utf-8") as f:
        f.write(",".join([CLOCK, *POSE.values(), "load_kg"]) + "\n")
        for i, t in enumerate(times):
            f.write(f"{t},{0.05 * i:.3f},{-0.02 * i:.3f},0.4,1,0,0,0,1.0,-0.4,0.0,12.5\n")
    with open(os.path.join(root, "shaker_log.csv"), "w", encoding="utf-8") as f:
        f.write(",".join([CLOCK, *IMU.values(), "fan_rpm"]) + "\n")
        for i, t in enumerate(times):
            f.write(f"{t},0.1,{0.02 * i:.3f},9.8,0.0,0.01,{0.004 * i:.4f},900\n")
    for t in times[::5]:
        with open(os.path.join(frames, f"mast-{t}.png"), "wb") as f:
            f.write(b"\x89PNG\r\n\x1a\n")


def completed(manifest: dict) -> dict:
    """The draft as a person would finish it."""
    streams = []
    for s in manifest["streams"]:
        kind, channels = {"warehouse_walk": ("pose", POSE), "shaker_log": ("imu", IMU)}.get(s["stream_id"], ("camera", s["channels"]))
        s = s | {"modality": kind, "type": kind, "channels": channels, "mapping_status": "final"}
        streams.append(s if kind == "camera" else s | {"timestamp": CLOCK, "timestamp_unit": "us"})
    return manifest | {"streams": streams, "mapping_status": "final"}


def run(root: str, spark: SparkSession | None = None) -> dict[str, object]:
    raw, out = os.path.join(root, "raw"), os.path.join(root, "managed")
    write_messy(raw)
    draft = suggest_manifest(inspect_dataset(raw, spark=spark), dataset_id="demo", robot_id="carrier", session_id="walk")
    report = ingest_manifest(completed(draft), output_root=out, row_group_rows=10, spark=spark)
    got = query_managed_dataset(out, channels=("pos_xyz", "rot_wxyz", "imu_accel"), target_hz=20, spark=spark)
    return {"warnings": draft["streams"][0].get("warnings", []), "row_groups": report.row_groups, "shape": list(got.tensor.shape), "output_root": report.output_root}
