"""Adapters: each knows one kind of dataset, from inspection to ingest. Others register by code or by entry point."""

from __future__ import annotations

import json
import os
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession

from ..plans.planner import session
from ..sources import generic, robots
from ..sources.store import list_objects
from . import calibration
from .ingest import Ingest
from .mapping import FROM_FILENAME, channels_of, confidence, final_errors, load, modality_of_columns, modality_of_name, modality_of_topic, suggest, time_columns, time_hint, topic_of, validate
from .records import DatasetFile, DatasetProfile, DatasetStream, IngestReport, ValidationReport

ENTRY_POINTS = "rowscout.adapters"


class DatasetAdapter(ABC):
    adapter_id: str
    version: str = "1"

    @abstractmethod
    def can_inspect(self, path: str) -> bool: ...

    @abstractmethod
    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile: ...

    def suggest_manifest(self, profile: DatasetProfile, *, dataset_id: str, robot_id: str, session_id: str, adapter_options: Mapping[str, Any] | None = None) -> dict[str, Any]:
        out = suggest(replace(profile, adapter_id=self.adapter_id), dataset_id, robot_id, session_id)
        return out | ({"adapter_options": dict(adapter_options)} if adapter_options else {})

    def validate_manifest(self, manifest) -> ValidationReport:
        return validate(manifest)

    def ingest(self, manifest, *, output_root: str, row_group_rows: int = 500, spark: SparkSession | None = None) -> IngestReport:
        """Streams of all kinds that stream_table knows, written as one atomic managed dataset."""
        data = load(manifest)
        report = self.validate_manifest(data)
        if not report.valid:
            raise ValueError("invalid manifest: " + "; ".join(report.errors))
        job = Ingest(session(spark), data, str(output_root), row_group_rows, self.adapter_id)
        self.preflight(job)
        return job.run(self.stream_table)

    def preflight(self, job: Ingest) -> None:
        """Checks before anything is written."""

    def stream_table(self, job: Ingest, stream: Mapping[str, Any], path: str):
        """The managed DataFrame of a stream; None if it can't be ingested."""
        return None


def _stream(stream_id: str, modality: str, path: str, times=(), channels=None, **more) -> DatasetStream:
    channels = channels if channels is not None else {}
    sure = more.pop("sure", None)
    return DatasetStream(stream_id, modality, path, tuple(times), dict(channels), confidence=sure if sure is not None else confidence(modality, times, channels), **more)


def _named(modality: str) -> dict[str, str]:
    return channels_of(modality, {"pose": robots.POSE_SCHEMA.names, "imu": robots.IMU_SCHEMA.names, "camera": ["filename", "data"]}[modality])


class EurocAdapter(DatasetAdapter):
    adapter_id = "euroc"

    def _members(self, path: str) -> tuple[str, list[str]]:
        if os.path.isdir(os.path.join(path, "mav0")):
            found = [os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(os.path.join(path, "mav0")) for f in names]
            return path, sorted(found)
        zipped = robots.first_zip(path)
        with zipfile.ZipFile(zipped) as z:
            return zipped, sorted(z.namelist())

    def can_inspect(self, path: str) -> bool:
        try:
            return any(m.startswith("mav0/") for m in self._members(path)[1])
        except (OSError, zipfile.BadZipFile):
            return False

    def _text(self, root: str, member: str) -> str:
        if root.endswith(".zip"):
            with zipfile.ZipFile(root) as z:
                return z.read(member).decode("utf-8", "replace")
        with open(os.path.join(root, member), encoding="utf-8", errors="replace") as f:
            return f.read()

    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile:
        root, members = self._members(str(path))
        streams, warnings = [], []
        for m in members:
            if not m.endswith("/data.csv"):
                continue
            sensor = m.split("/")[1]
            modality = "imu" if sensor.startswith("imu") else "camera" if sensor.startswith("cam") else "pose" if "groundtruth" in sensor else None
            if modality is None:
                continue
            found, said = None, []
            if f"mav0/{sensor}/sensor.yaml" in members:
                found, said = calibration.read_text("sensor.yaml", self._text(root, f"mav0/{sensor}/sensor.yaml"))
            warnings += said
            streams.append(_stream(sensor, modality, root, ("timestamp_ns",), _named(modality), sure=0.95, calibration=found, warnings=tuple(said), discovery={"member": m}))
        files = tuple(DatasetFile(m, "euroc_member") for m in members if m.endswith((".csv", ".yaml")))
        return DatasetProfile(1, str(path), "euroc", files, tuple(streams), tuple(warnings), self.adapter_id)

    def stream_table(self, job: Ingest, stream, path):
        member = (stream.get("discovery") or {}).get("member")
        if stream["modality"] == "pose":
            return robots.euroc_groundtruth(job.spark, path, job.robot_id, job.session_id, member or robots.EUROC["pose"])
        if stream["modality"] == "imu":
            return robots.euroc_imu(job.spark, path, job.robot_id, job.session_id, member or robots.EUROC["imu"])
        return robots.euroc_camera(job.spark, path, stream["stream_id"], job.robot_id, job.session_id)


class ParquetAdapter(DatasetAdapter):
    """Tables that already have the managed schemas."""

    adapter_id = "normalized_parquet"

    def can_inspect(self, path: str) -> bool:
        if not str(path).endswith(".parquet") or not os.path.isfile(path):
            return False
        import pyarrow.parquet as pq

        names = set(pq.read_schema(path).names)
        return any(set(s.names) - {"velocity"} <= names for s in (robots.POSE_SCHEMA, robots.IMU_SCHEMA, robots.CAMERA_SCHEMA))

    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile:
        import pyarrow.parquet as pq

        file = pq.ParquetFile(path)
        names = file.schema_arrow.names
        modality = modality_of_columns(names)
        stream = _stream(os.path.basename(path).split(".")[0], modality, str(path), time_columns(names), channels_of(modality, names), row_count=file.metadata.num_rows)
        entry = DatasetFile(str(path), "parquet", os.path.getsize(path), file.metadata.num_rows, tuple(names))
        return DatasetProfile(1, str(path), "normalized_parquet", (entry,), (stream,), (), self.adapter_id)

    def stream_table(self, job: Ingest, stream, path):
        return job.spark.read.parquet(path)


class McapAdapter(DatasetAdapter):
    adapter_id = "mcap_pose"

    def can_inspect(self, path: str) -> bool:
        return str(path).endswith(".mcap")

    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile:
        from ..sources.mcap import messages

        topics: dict[str, dict[str, Any]] = {}
        with open(path, "rb") as f:
            for topic, encoding, schema, _, _ in messages(f.read()):
                topics.setdefault(topic, {"topic": topic, "encoding": encoding, "schema": schema, "n": 0})["n"] += 1
        streams = []
        for topic, found in topics.items():
            modality = modality_of_topic(topic, found["schema"])
            pose = modality == "pose"
            if pose and found["encoding"] not in ("json", "ros1", "cdr"):
                pose, modality = False, "media"  # poses of other encodings can't be read
            streams.append(_stream(topic.strip("/").replace("/", "_") or "pose", modality, str(path), ("timestamp_ns", "log_time"), _named("pose") if pose else {}, row_count=found.pop("n"), discovery=found))
        entry = DatasetFile(str(path), "mcap", os.path.getsize(path), topics=tuple(topics), schema_names=tuple(sorted({t["schema"] for t in topics.values()})))
        return DatasetProfile(1, str(path), "mcap", (entry,), tuple(streams), () if streams else ("no messages",), self.adapter_id)

    def stream_table(self, job: Ingest, stream, path):
        from ..sources.mcap import read_poses

        if stream["modality"] != "pose":
            return None
        return read_poses(job.spark, path, topic_of(job.data, stream, "/pose"), job.robot_id, job.session_id)


class KittiAdapter(DatasetAdapter):
    adapter_id = "kitti_oxts"

    def can_inspect(self, path: str) -> bool:
        return os.path.isdir(os.path.join(path, "oxts", "data"))

    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile:
        packets = sorted(os.listdir(os.path.join(path, "oxts", "data")))
        stream = _stream("oxts", "pose", str(path), ("timestamp_ns",), _named("pose"), row_count=len(packets))
        return DatasetProfile(1, str(path), "kitti_oxts", (DatasetFile(os.path.join(str(path), "oxts"), "kitti_oxts", row_count=len(packets)),), (stream,), (), self.adapter_id)

    def stream_table(self, job: Ingest, stream, path):
        return robots.kitti_oxts(job.spark, path, job.robot_id, job.session_id)


class NuscenesAdapter(DatasetAdapter):
    adapter_id = "nuscenes_ego"

    def can_inspect(self, path: str) -> bool:
        try:
            return os.path.isdir(path) and bool(robots.nuscenes_file(path))
        except FileNotFoundError:
            return False

    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile:
        found = robots.nuscenes_file(path)
        stream = _stream("ego_pose", "pose", str(path), ("timestamp_ns",), _named("pose"))
        return DatasetProfile(1, str(path), "nuscenes", (DatasetFile(found, "json", os.path.getsize(found)),), (stream,), (), self.adapter_id)

    def stream_table(self, job: Ingest, stream, path):
        return robots.nuscenes_ego(job.spark, path, job.robot_id, job.session_id)


class GenericAdapter(DatasetAdapter):
    """Folders of CSV, Parquet, MCAP and images. Its manifests are drafts until someone says they are final."""

    adapter_id = "generic_dataset"

    def can_inspect(self, path: str) -> bool:
        return True

    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile:
        path = str(path)
        if path.startswith(("s3://", "s3a://")):
            return self._inspect_prefix(path, session(spark))
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        files, streams, warnings = [], [], []
        tables = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)
        for name in tables:
            low = name.lower()
            if low.endswith((".csv", ".parquet")):
                columns, rows = self._columns(name)
                modality, times = modality_of_columns(columns), time_columns(columns)
                found = channels_of(modality, columns)
                said = () if found and times else ("columns don't say what they are",)
                hint = time_hint(times[0]) if times else {}
                streams.append(_stream(os.path.basename(name).rsplit(".", 1)[0], modality, name, times, found, row_count=rows, warnings=said, discovery=hint))
                files.append(DatasetFile(name, low.rsplit(".", 1)[-1], os.path.getsize(name), rows, tuple(columns)))
            elif low.endswith(".mcap"):
                inner = McapAdapter().inspect(name)
                files += inner.files
                streams += inner.streams
        folders = sorted({os.path.dirname(f) for f in (generic.image_files(path) if os.path.isdir(path) else [])})
        for folder in folders:
            found, said = calibration.beside(folder)
            names = [f for f in generic.image_files(folder) if os.path.dirname(f) == folder]
            streams.append(
                _stream(os.path.basename(folder) or "camera", "camera", folder, (FROM_FILENAME,), {"frame_path": "filename", "camera_bytes": "data"}, row_count=len(names), calibration=found, warnings=tuple(said))
            )
            files.append(DatasetFile(folder, "image_sequence", sum(map(os.path.getsize, names)), len(names)))
            warnings += said
        if not streams:
            warnings.append("nothing here that could be a stream")
        unique = {(s.stream_id, s.modality, s.source_path): s for s in reversed(streams)}
        return DatasetProfile(1, path, "generic", tuple(files), tuple(s for s in streams if unique[s.stream_id, s.modality, s.source_path] is s), tuple(dict.fromkeys(warnings)), self.adapter_id)

    def _columns(self, name: str) -> tuple[list[str], int | None]:
        if name.endswith(".parquet"):
            import pyarrow.parquet as pq

            file = pq.ParquetFile(name)
            return file.schema_arrow.names, file.metadata.num_rows
        with open(name, encoding="utf-8", errors="replace") as f:
            head = f.readline().strip()
        return [c.strip().strip('"') for c in head.split(",") if c.strip()], None

    def _inspect_prefix(self, uri: str, spark: SparkSession) -> DatasetProfile:
        """A listing (500 objects at most); streams of at most 20 Parquet and 20 MCAP objects, by name alone."""
        found = list_objects(spark, uri.replace("s3://", "s3a://", 1), 500)
        files = tuple(DatasetFile(o.path, o.path.rsplit(".", 1)[-1], o.size) for o in found)
        picked = [f for kind in ("parquet", "mcap") for f in [x for x in files if x.kind == kind][:20]]
        streams = tuple(_stream(os.path.basename(f.path).rsplit(".", 1)[0], modality_of_name(f.path), f.path, sure=0.3) for f in picked)
        return DatasetProfile(1, uri, "s3_prefix", files, streams, ("schemas were not read; stage the prefix to inspect them",), self.adapter_id)

    def suggest_manifest(self, profile, *, dataset_id, robot_id, session_id, adapter_options=None):
        out = suggest(replace(profile, adapter_id=self.adapter_id), dataset_id, robot_id, session_id, draft=True)
        return out | ({"adapter_options": dict(adapter_options)} if adapter_options else {})

    def preflight(self, job: Ingest) -> None:
        errors = final_errors(job.data)
        for stream, path in job.streams():
            at = stream.get("stream_id")
            if not os.path.exists(path):
                errors.append(f"{at}: {path} does not exist")
            elif stream["modality"] == "camera":
                bad = generic.unnamed_images(path)
                if bad or not generic.image_files(path):
                    errors.append(f"{at}: image names without a time: {', '.join(map(os.path.basename, bad[:3])) or 'no images'}")
            elif not path.endswith(".mcap") and stream["modality"] in ("pose", "imu"):
                df = generic.relation(job.spark, path)
                need = [stream.get("timestamp"), *dict(stream.get("channels", {})).values()]
                lacks = [c for c in need if c not in df.columns]
                if lacks:
                    errors.append(f"{at}: columns {', '.join(map(str, lacks))} are missing")
                elif n := generic.bad_numbers(df, stream["timestamp"]):
                    errors.append(f"{at}: {n} timestamps in {stream['timestamp']} are no numbers")
        if errors:
            raise ValueError("generic ingest refused: " + "; ".join(errors))

    def stream_table(self, job: Ingest, stream, path):
        scale = job.scale(stream)
        if stream["modality"] == "camera":
            return generic.image_table(job.spark, path, stream["stream_id"], scale, job.robot_id, job.session_id)
        if path.endswith(".mcap"):
            return McapAdapter().stream_table(job, stream, path)
        mapping = {"timestamp": stream["timestamp"], **stream["channels"]}
        make = generic.pose_table if stream["modality"] == "pose" else generic.imu_table
        return make(generic.relation(job.spark, path), mapping, scale, job.robot_id, job.session_id)


class MediaPlaceholderAdapter(GenericAdapter):
    """Asked for by name only: every stream is media of unknown form, to be mapped by hand later."""

    adapter_id = "generic_media_placeholder"

    def inspect(self, path: str, spark: SparkSession | None = None) -> DatasetProfile:
        found = super().inspect(path, spark)
        streams = tuple(replace(s, modality="media", channels={}, confidence=confidence("media", s.timestamp_candidates, {})) for s in found.streams)
        return replace(found, streams=streams)


class AdapterRegistry:
    """Adapters in order; the first that can inspect a path is chosen."""

    def __init__(self, *, load_entry_points: bool = True):
        self.adapters: dict[str, DatasetAdapter] = {}
        for kind in (EurocAdapter, ParquetAdapter, McapAdapter, KittiAdapter, NuscenesAdapter, GenericAdapter, MediaPlaceholderAdapter):
            self.register(kind())
        if load_entry_points:
            from importlib.metadata import entry_points

            for point in entry_points(group=ENTRY_POINTS):
                self.register(point.load()(), first=True)

    def register(self, adapter: DatasetAdapter, first: bool = False) -> None:
        rest = {k: v for k, v in self.adapters.items() if k != adapter.adapter_id}
        self.adapters = {adapter.adapter_id: adapter, **rest} if first else {**rest, adapter.adapter_id: adapter}

    def get(self, adapter_id: str) -> DatasetAdapter:
        if adapter_id not in self.adapters:
            raise KeyError(f"unknown adapter {adapter_id!r}; there are {', '.join(self.adapters)}")
        return self.adapters[adapter_id]

    def for_path(self, path: str) -> DatasetAdapter:
        return next(a for a in self.adapters.values() if a.can_inspect(path))

    def for_manifest(self, data: Mapping[str, Any]) -> DatasetAdapter:
        return self.get(str(data.get("adapter_id") or "generic_dataset"))


_REGISTRY: list[AdapterRegistry] = []


def adapter_registry() -> AdapterRegistry:
    if not _REGISTRY:
        _REGISTRY.append(AdapterRegistry())
    return _REGISTRY[0]


def register_adapter(adapter: DatasetAdapter) -> None:
    """A new adapter is asked before those there are."""
    adapter_registry().register(adapter, first=True)


def get_adapter(adapter_id: str) -> DatasetAdapter:
    return adapter_registry().get(adapter_id)


def list_adapters() -> list[dict[str, str]]:
    return [{"adapter_id": a.adapter_id, "version": a.version} for a in adapter_registry().adapters.values()]


def inspect_dataset(path, adapter_id: str = "auto", spark: SparkSession | None = None) -> DatasetProfile:
    adapter = adapter_registry().for_path(str(path)) if adapter_id == "auto" else get_adapter(adapter_id)
    return adapter.inspect(str(path), spark)


def suggest_manifest(profile, *, dataset_id: str, robot_id: str, session_id: str, adapter_id: str = "auto", adapter_options=None) -> dict[str, Any]:
    profile = profile if isinstance(profile, DatasetProfile) else DatasetProfile.from_dict(profile)
    adapter = get_adapter(profile.adapter_id or "generic_dataset" if adapter_id == "auto" else adapter_id)
    return adapter.suggest_manifest(profile, dataset_id=dataset_id, robot_id=robot_id, session_id=session_id, adapter_options=adapter_options)


def validate_manifest(manifest, *, adapter_id: str = "auto") -> ValidationReport:
    data = load(manifest)
    adapter = adapter_registry().for_manifest(data) if adapter_id == "auto" else get_adapter(adapter_id)
    return adapter.validate_manifest(data)


def ingest_manifest(manifest, *, output_root, row_group_rows: int = 500, adapter_id: str = "auto", spark: SparkSession | None = None) -> IngestReport:
    data = load(manifest)
    adapter = adapter_registry().for_manifest(data) if adapter_id == "auto" else get_adapter(adapter_id)
    return adapter.ingest(data, output_root=str(output_root), row_group_rows=row_group_rows, spark=spark)


def write_json(path: str, body) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2)
