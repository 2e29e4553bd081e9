"""Camera frames of selected row groups as files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..operators.audit import DEFAULT_FOOTER_BYTES, Span
from ..schemas import CAMERA_SCHEMA


def frame_name(ts: int, frame_path: str) -> str:
    """<time>.<extension of the source path, cleaned, or bin>."""
    extension = frame_path.rsplit("/", 1)[-1].rpartition(".")[2] if "." in frame_path.rsplit("/", 1)[-1] else ""
    clean = re.sub("[^A-Za-z0-9]", "", extension)
    return f"{ts}.{clean or 'bin'}"


def safe_part(name: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_.-]", "_", name).strip(".")
    return clean or "stream"


def extract_frames(
    spark: SparkSession,
    files: Sequence[tuple[str, Sequence[Span]]],
    out: str,
    enforce: bool = False,
    footer_bytes: int = DEFAULT_FOOTER_BYTES,
    window: tuple[int, int] | None = None,
) -> dict[str, object]:
    """Writes <out>/<stream>/<time>.<ext> for every frame of the row groups (of the window only, if one is given) and
    returns the manifest. Tasks write where they run, so `out` must be a folder that all see."""
    from ..sources.rowgroups import read_groups

    rows = [(u, [s.row_group_id for s in spans], [s.offset for s in spans], [s.length for s in spans]) for u, spans in files]
    listed = spark.createDataFrame(rows, "uri string, ids array<int>, offsets array<long>, lengths array<long>")
    names = [f.name for f in CAMERA_SCHEMA]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                spans = [Span(i, o, n) for i, o, n in zip(row["ids"], row["offsets"], row["lengths"], strict=True)]
                got, report, records = read_groups(row["uri"], row["ids"], names, spans if enforce else None, footer_bytes)
                made = []
                for frame in got.to_pylist():
                    ts = frame["timestamp_ns"]
                    if window and not window[0] <= ts <= window[1]:
                        continue
                    folder = os.path.join(out, safe_part(frame["stream_id"]))
                    os.makedirs(folder, exist_ok=True)
                    path = os.path.join(folder, frame_name(ts, frame["frame_path"]))
                    with open(path + ".part", "wb") as f:
                        f.write(frame["camera_bytes"])
                    os.replace(path + ".part", path)  # a task that runs again leaves the same file
                    made.append({"timestamp_ns": ts, "stream_id": frame["stream_id"], "path": path, "bytes": len(frame["camera_bytes"])})
                told = json.dumps({"uri": row["uri"], "frames": made, "audit": {"report": report, "records": records} if enforce else None})
                yield pa.RecordBatch.from_arrays([pa.array([told])], ["told"])

    told = [json.loads(r["told"]) for r in listed.repartition(max(1, len(rows))).mapInArrow(run, "told string").collect()]
    frames = sorted((f for t in told for f in t["frames"]), key=lambda f: (f["stream_id"], f["timestamp_ns"]))
    out_manifest: dict[str, object] = {"version": 1, "frames": frames, "frame_count": len(frames), "materialized_bytes": sum(f["bytes"] for f in frames)}
    if enforce:
        out_manifest["audit"] = [t["audit"] for t in told]
    return out_manifest
