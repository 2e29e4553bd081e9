"""Records of onboarding: what a dataset holds, whether a mapping is sound, what an ingest made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any


class _Record:
    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def _build(kind, data: Mapping[str, Any]):
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known})


#: The fields' names of the records below are the keys of the public JSON profiles, manifests and reports.
@dataclass(frozen=True)
class DatasetFile(_Record):
    path: str
    kind: str
    size_bytes: int = 0
    row_count: int | None = None
    columns: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    schema_names: tuple[str, ...] = ()
    discovery: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class DatasetStream(_Record):
    stream_id: str
    modality: str
    source_path: str
    timestamp_candidates: tuple[str, ...] = ()
    channels: dict[str, str] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    frame_id: str = ""
    row_count: int | None = None
    calibration: dict[str, Any] | None = None
    confidence: float | None = None
    warnings: tuple[str, ...] = ()
    discovery: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class DatasetProfile(_Record):
    version: int
    input_uri: str
    dataset_format: str
    files: tuple[DatasetFile, ...]
    streams: tuple[DatasetStream, ...]
    warnings: tuple[str, ...] = ()
    adapter_id: str = ""
    discovery: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> DatasetProfile:
        return cls(
            int(data.get("version", 1)),
            str(data.get("input_uri", "")),
            str(data.get("dataset_format", "unknown")),
            tuple(_build(DatasetFile, f) for f in data.get("files", ())),
            tuple(_build(DatasetStream, s) for s in data.get("streams", ())),
            tuple(map(str, data.get("warnings", ()))),
            str(data.get("adapter_id", "")),
            dict(data.get("discovery", {})),
        )


@dataclass(frozen=True)
class ValidationReport(_Record):
    valid: bool
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    stream_count: int = 0
    modalities: tuple[str, ...] = ()


@dataclass(frozen=True)
class IngestReport(_Record):
    dataset_id: str
    output_root: str
    outputs: dict[str, str]
    row_groups: dict[str, int]
    bytes: dict[str, int]
    warnings: tuple[str, ...] = ()
    unsupported_streams: tuple[str, ...] = ()
    adapter_id: str = ""
    calibrations: dict[str, dict[str, Any]] = field(default_factory=dict)
