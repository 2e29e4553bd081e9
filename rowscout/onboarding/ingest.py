"""The ingest of a manifest: managed tables, catalogs and reports, all or nothing."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import scale_of
from ..operators import catalog
from ..schemas import CAMERA_SCHEMA, IMU_SCHEMA, POSE_SCHEMA
from ..sinks.tables import atomic_folder, parquet_files, write_managed
from .records import IngestReport

_SCHEMAS = {"pose": POSE_SCHEMA, "imu": IMU_SCHEMA, "camera": CAMERA_SCHEMA}


@dataclass
class Ingest:
    spark: SparkSession
    data: Mapping[str, Any]
    root: str
    row_group_rows: int
    adapter_id: str

    @property
    def robot_id(self) -> str:
        return str(self.data["robot_id"])

    @property
    def session_id(self) -> str:
        return str(self.data["session_id"])

    def streams(self) -> Iterator[tuple[Mapping[str, Any], str]]:
        paths = {s["source_id"]: str(s["path"]) for s in self.data["sources"]}
        return ((s, paths[s["source_id"]]) for s in self.data["streams"])

    def scale(self, stream: Mapping[str, Any]) -> float:
        column = str(stream.get("timestamp") or "")
        return scale_of(dict(stream), "" if column == "timestamp_from_filename" else column)

    def run(self, table_of: Callable[[Ingest, Mapping[str, Any], str], DataFrame | None]) -> IngestReport:
        """Writes tables/<stream>, the catalog root and the manifest. All streams of a kind share that kind's catalog."""
        made: dict[str, list[tuple[str, str]]] = {k: [] for k in _SCHEMAS}
        passed_over, warnings, calibrations = [], [], {}
        with atomic_folder(self.root) as tmp:
            for stream, path in self.streams():
                df = table_of(self, stream, path) if stream["modality"] in _SCHEMAS else None
                if df is None:
                    passed_over.append(stream["stream_id"])
                    continue
                kind = stream["modality"]
                folder = f"{tmp}/tables/{kind}/{stream['stream_id']}"
                write_managed(df, _SCHEMAS[kind], folder, 20 if kind == "camera" else self.row_group_rows)
                made[kind].append((stream["stream_id"], folder))
                if stream.get("calibration"):
                    calibrations[stream["stream_id"]] = dict(stream["calibration"])
            if not made["pose"]:
                warnings.append("no pose stream: there is no catalog to query")
            final = lambda p: p.replace(tmp, os.path.abspath(self.root), 1)
            cats: dict[str, DataFrame | None] = {}
            for kind, tables in made.items():
                parts = [catalog.index_files(self.spark, parquet_files(folder), kind) for _, folder in tables]
                whole = reduce(DataFrame.unionByName, parts) if parts else None
                cats[kind] = whole.withColumn("file_uri", F.replace("file_uri", F.lit(tmp), F.lit(os.path.abspath(self.root)))) if whole is not None else None
            if cats["pose"] is not None:
                catalog.save(f"{tmp}/catalog/dataset", cats["pose"], cats["imu"], cats["camera"])
            groups = {k: df.count() for k, df in cats.items() if df is not None}
            sizes = {k: sum(os.path.getsize(f) for _, folder in tables for f in parquet_files(folder)) for k, tables in made.items() if tables}
            outputs = {f"{k}:{name}": final(folder) for k, tables in made.items() for name, folder in tables}
            if cats["pose"] is not None:
                outputs["catalog"] = final(f"{tmp}/catalog/dataset")
            report = IngestReport(
                str(self.data["dataset_id"]), os.path.abspath(self.root), outputs, groups, sizes, tuple(warnings), tuple(passed_over), self.adapter_id, calibrations
            )
            for name, body in (("manifest.json", dict(self.data)), ("ingest_report.json", report.to_dict())):
                with open(f"{tmp}/{name}", "w", encoding="utf-8") as f:
                    json.dump(body, f, indent=2)
        return report
