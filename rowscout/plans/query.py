"""Queries: plan, gate, read the authorised row groups, align, report."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, replace
from itertools import groupby

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import DEFAULT_FOOTER_BYTES, RangeViolationError, Span
from ..operators.motion import quaternion_inversions
from ..operators.resample import assemble, tensorize, tensorize_both
from ..schemas import CHANNELS, IMU_SCHEMA, POSE_SCHEMA
from ..sinks.media import extract_frames
from ..sources.rowgroups import kept, scan
from .planner import DEFAULT_CHANNELS, DEFAULT_EGRESS, plan, plan_batch, session, split_channels
from .report import (
    BatchQueryResult,
    EgressLimitError,
    ExtrapolationError,
    QueryResult,
    ReadTotals,
    RowGroupSpan,
    SeekPlan,
    certificate,
    combined,
    combined_certificate,
    validity_warnings,
)

OUTPUTS = ("numpy", "torch", "dataframe")
WINDOW = ["window_id"]


def _files(spans: Sequence[RowGroupSpan]) -> list[tuple[str, list[Span]]]:
    ordered = sorted(spans, key=lambda s: s.file_uri)
    return [(u, [Span(s.row_group_id, s.byte_offset, s.byte_length) for s in g]) for u, g in groupby(ordered, lambda s: s.file_uri)]


class _Reader:
    """Scans of one query. Under enforcement a scan is checkpointed, so that no range is read again after its audit has been
    taken, and the single reads are kept by file."""

    def __init__(self, spark: SparkSession, enforce: bool, footer_bytes: int):
        self.spark, self.enforce, self.footer_bytes = spark, enforce, footer_bytes
        self.records: dict[str, list[dict]] = {}

    def read(self, schema, spans: Sequence[RowGroupSpan]) -> DataFrame:
        df = scan(self.spark, schema, _files(spans), self.enforce, self.footer_bytes)
        if self.enforce:
            df = kept(df)
            for row in df.where("audit is not null").select("file_uri", "audit").collect():  # a row for each file
                self.records.setdefault(row["file_uri"], []).extend(json.loads(row["audit"])["records"])
        return df.where("audit is null").drop("audit")

    def totals(self) -> ReadTotals:
        """All that was read, each read once."""
        return ReadTotals.of(r for records in self.records.values() for r in records)

    def totals_of(self, w: SeekPlan, media: Sequence[dict] = ()) -> ReadTotals:
        """What was read for a window: the footers of its files, reads within its row groups, and its media's reads."""
        mine = []
        for uri, spans in _files((*w.pose_row_groups, *w.imu_row_groups)):
            inside = lambda r: any(s.offset <= r["offset"] and r["offset"] + r["length"] <= s.offset + s.length for s in spans)  # noqa: B023, E731
            mine += [r for r in self.records.get(uri, ()) if r["category"] != "authorized" or inside(r)]
        return ReadTotals.of([*mine, *media])


def _raised(e: PySparkException) -> Exception:
    """The library's own error behind a failed job."""
    text = str(e)
    if "extrapolation needed" in text:
        return ExtrapolationError(text.splitlines()[0][:500])
    if "RangeViolationError" in text or "unauthorized read" in text:
        return RangeViolationError(next((x for x in text.splitlines() if "RangeViolationError" in x), text)[:500])
    return RuntimeError(text[:2000])


def _windows_frame(spark: SparkSession, windows: Sequence[SeekPlan]) -> DataFrame:
    return spark.createDataFrame([(i, w.start_ts_ns, w.end_ts_ns) for i, w in enumerate(windows)], "window_id int, start_ts_ns long, end_ts_ns long")


def _samples(reader: _Reader, schema, windows: Sequence[SeekPlan], kind: str) -> DataFrame:
    """Samples of the windows' row groups, each with the windows that it belongs to.

    A file belongs to the windows that selected row groups of it; a row group that two windows share is read once.
    """
    spark = reader.spark
    spans = {s for w in windows for s in getattr(w, f"{kind}_row_groups")}
    df = reader.read(schema, sorted(spans, key=lambda s: (s.file_uri, s.row_group_id)))
    homes = {(i, s.file_uri, s.row_group_id) for i, w in enumerate(windows) for s in getattr(w, f"{kind}_row_groups")}
    home = spark.createDataFrame(sorted(homes), "window_id int, file_uri string, row_group_id int")
    return df.join(F.broadcast(home), ["file_uri", "row_group_id"])  # home: a row for each planned span


def _materialize(spark, windows: Sequence[SeekPlan], scalar: Sequence[str], hz: float, reader: _Reader):
    """The tensor rows of all windows (one DataFrame), and the pose samples they come from."""
    frame = _windows_frame(spark, windows)
    poses = _samples(reader, POSE_SCHEMA, windows, "pose")
    if any(c.startswith("imu_") for c in scalar):
        tensor = tensorize_both(poses, _samples(reader, IMU_SCHEMA, windows, "imu"), frame, WINDOW, hz)
    else:
        tensor = tensorize(poses, frame, WINDOW, hz)
    return assemble(tensor, None, WINDOW, scalar), poses


def _columns(scalar: Sequence[str]) -> int:
    return sum(len(CHANNELS[c][0]) for c in scalar)


def _container(values: np.ndarray, output: str):
    if output == "torch":
        try:
            import torch
        except ModuleNotFoundError as e:
            raise RuntimeError("output='torch' needs the torch package") from e
        return torch.from_numpy(values)
    return values


def _manifest(p: SeekPlan, report, cert, reader: _Reader, t: ReadTotals, inputs: dict, media_manifest) -> dict[str, object]:
    return p.to_manifest() | {
        "plan_inputs": inputs,
        "actual_reads": t.records,
        "actual_cold_reads": t.reads,
        "actual_cold_read_bytes": t.bytes,
        "actual_authorized_bytes": t.authorized_bytes,
        "authorized_row_group_bytes": p.materialized_pose_imu_bytes,
        "footer_allowance_bytes": reader.footer_bytes,
        "footer_bytes": t.footer_bytes,
        "largest_metadata_read": t.largest_footer_read,
        "max_footer_read_offset": t.max_offset,
        "max_footer_read_end": t.max_end,
        "materialized_bytes": t.authorized_bytes if reader.enforce else p.materialized_pose_imu_bytes,
        "media_planned_bytes": p.authorized_media_bytes,
        "violations": [r for r in t.records if r["category"] == "violation"],
        "enforcement_enabled": reader.enforce,
        "diagnostics": asdict(report),
        "tensor_certificate": asdict(cert),
        "media_materialization_manifest": media_manifest,
    }


def _run(
    spark, windows: Sequence[SeekPlan], channels, hz, output, enforce, footer_bytes, materialize_media, media_out, predicate, batch: bool
) -> tuple[list[QueryResult], ReadTotals]:
    """Results of the windows, and what was read for all of them."""
    scalar, media = split_channels(channels)
    reader = _Reader(spark, enforce, footer_bytes)
    try:
        rows, poses = _materialize(spark, windows, scalar, hz, reader)
        inversions = quaternion_inversions(poses, keys=WINDOW)
        if output == "dataframe":
            arrays, turned = None, {}
        else:
            pdf = rows.orderBy("window_id", "k").toPandas()
            turned = {r["window_id"]: r["inversions"] for r in inversions.collect()}
            arrays = {i: g for i, g in pdf.groupby("window_id")}
        out = []
        for i, w in enumerate(windows):
            if arrays is None:
                tensor, times, shape, span, warnings = rows.where(F.col("window_id") == i).drop("window_id"), None, (-1, _columns(scalar)), (w.start_ts_ns, w.end_ts_ns), ()
            else:
                g = arrays[i]
                times = g["ts_ns"].to_numpy(np.int64)
                values = g.drop(columns=["window_id", "k", "ts_ns"]).to_numpy(np.float64)
                warnings, shape = validity_warnings(values, times, scalar), values.shape
                span = (int(times[0]), int(times[-1])) if len(times) else None
                tensor = _container(values, output)
            frames, media_reads = None, []
            if materialize_media and w.media_row_groups:
                if media_out is None:
                    raise ValueError("materialize_media needs media_out=...")
                if any(s.modality != "camera" for s in w.media_row_groups):
                    raise ValueError("only camera streams can be materialized")
                root = f"{media_out}/window_{i:03}_{_safe(w.session_id)}" if batch else str(media_out)
                frames = extract_frames(spark, _files(w.media_row_groups), root, enforce, footer_bytes)
                if frames.get("audit"):
                    media_reads = [r for told in frames.pop("audit") for r in told["records"]]
                    reader.records.setdefault(root, []).extend(media_reads)
            t = reader.totals_of(w, media_reads)
            report = replace(
                w.diagnostics, quaternion_inversions_applied=int(turned.get(i, 0)), extrapolation_checked=True, range_audit_passed=enforce and t.violations == 0,
                footer_allowance_bytes=footer_bytes, range_enforced=enforce, **t.fields(),
            )
            cert = certificate(w, report, shape, span, scalar, media, hz, warnings)
            inputs = {"predicate": predicate, "channels": list(channels), "target_hz": hz, "enforce_ranges": enforce, "footer_allowance_bytes": footer_bytes}
            manifest = _manifest(w, report, cert, reader, t, inputs, frames)
            out.append(QueryResult(tensor, times, w.row_groups, w.pose_file_uri, w.authorized_total_bytes, output, report, manifest, frames, cert))
        return out, reader.totals()
    except PySparkException as e:
        raise _raised(e) from e


def _safe(name: str) -> str:
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in name) or "session"


def _write_json(path, body: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(str(path))), exist_ok=True)
    with open(str(path), "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2)


def _check_output(output: str) -> None:
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {', '.join(OUTPUTS)}")


def query(
    *,
    target_hz: float = 30.0,
    output: str = "numpy",
    enforce_ranges: bool = False,
    footer_allowance_bytes: int = DEFAULT_FOOTER_BYTES,
    manifest_out=None,
    materialize_media: bool = False,
    media_out=None,
    channels: Sequence[str] = DEFAULT_CHANNELS,
    max_egress_bytes: int = DEFAULT_EGRESS,
    spark: SparkSession | None = None,
    **planning,
) -> QueryResult:
    """One window as a [T, C] tensor (numpy, torch, or a DataFrame that is not computed yet), with report, manifest and
    certificate. Takes plan()'s arguments. Raises EgressLimitError before anything is read."""
    _check_output(output)
    spark = session(spark)
    p = plan(channels=channels, max_egress_bytes=max_egress_bytes, spark=spark, **planning)
    if p.blocked_by_egress:
        raise EgressLimitError(f"the plan selects {p.authorized_total_bytes} bytes; the limit is {max_egress_bytes}")
    (result,), _ = _run(spark, [p], channels, target_hz, output, enforce_ranges, footer_allowance_bytes, materialize_media, media_out, planning.get("predicate"), False)
    if manifest_out is not None:
        _write_json(manifest_out, result.manifest)
    return result


def query_batch(
    *,
    target_hz: float = 30.0,
    output: str = "numpy",
    enforce_ranges: bool = False,
    footer_allowance_bytes: int = DEFAULT_FOOTER_BYTES,
    manifest_out=None,
    materialize_media: bool = False,
    media_out=None,
    channels: Sequence[str] = DEFAULT_CHANNELS,
    max_egress_bytes: int = DEFAULT_EGRESS,
    spark: SparkSession | None = None,
    **planning,
) -> BatchQueryResult:
    """All windows, aligned in one job and returned apart: sessions are never joined into one timeline."""
    _check_output(output)
    spark = session(spark)
    p = plan_batch(channels=channels, max_egress_bytes=max_egress_bytes, spark=spark, **planning)
    if p.blocked_by_egress:
        raise EgressLimitError(f"the plan selects {p.authorized_total_bytes} bytes; the limit is {max_egress_bytes}")
    results, reads = _run(spark, p.windows, channels, target_hz, output, enforce_ranges, footer_allowance_bytes, materialize_media, media_out, planning.get("predicate"), True)
    report = replace(combined([r.diagnostics for r in results], reads), blocked_by_egress=False)
    cert = combined_certificate([r.certificate for r in results], reads)
    manifest = p.to_manifest() | reads.fields() | {"windows": [r.manifest for r in results], "diagnostics": asdict(report), "tensor_certificate": asdict(cert)}
    if manifest_out is not None:
        _write_json(manifest_out, manifest)
    return BatchQueryResult(tuple(results), p.authorized_total_bytes, output, report, manifest, cert)


def query_managed_dataset(output_root, **options) -> QueryResult:
    """query() on what an ingest wrote under output_root."""
    root = f"{output_root}/catalog/dataset"
    if not os.path.isdir(root):
        raise FileNotFoundError(f"there is no managed catalog at {root}")
    return query(catalog_db=root, **options)
