"""Byte-range authority: planned reads, preflight, and the classification of every read that took place."""

from __future__ import annotations

import io
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FOOTER_BYTES = 16 * 1024 * 1024


class RangeViolationError(RuntimeError):
    """A read outside the authorised ranges."""


@dataclass(frozen=True)
class Span:
    row_group_id: int
    offset: int
    length: int


@dataclass
class ReadRecord:
    offset: int
    length: int
    category: str  # authorized, footer or violation


@dataclass
class RangeAuditor:
    """Decides on reads of one file. A read is authorized if it lies in one span as a whole; else it counts as footer
    while the footer phase is open and it lies in the file's last footer_bytes; else it is a violation and raises."""

    file_size: int
    spans: Sequence[Span]
    footer_bytes: int = DEFAULT_FOOTER_BYTES
    footer_open: bool = True
    reads: list[ReadRecord] = field(default_factory=list)

    def close_footer(self) -> None:
        self.footer_open = False

    def category(self, offset: int, length: int) -> str:
        end = offset + length
        if length < 0 or offset < 0 or end > self.file_size:
            return "violation"
        if any(s.offset <= offset and end <= s.offset + s.length for s in self.spans):
            return "authorized"
        if self.footer_open and offset >= self.file_size - self.footer_bytes:
            return "footer"
        return "violation"

    def record(self, offset: int, length: int) -> str:
        kind = self.category(offset, length)
        self.reads.append(ReadRecord(offset, length, kind))
        if kind == "violation":
            raise RangeViolationError(f"unauthorized read of {length} bytes at {offset}")
        return kind

    def report(self) -> dict[str, int]:
        of = lambda k: [r for r in self.reads if r.category == k]
        return {
            "reads": len(self.reads),
            "bytes": sum(r.length for r in self.reads),
            "authorized_reads": len(of("authorized")),
            "authorized_bytes": sum(r.length for r in of("authorized")),
            "footer_reads": len(of("footer")),
            "footer_bytes": sum(r.length for r in of("footer")),
            "largest_footer_read": max((r.length for r in of("footer")), default=0),
            "max_offset": max((r.offset for r in self.reads), default=0),
            "max_end": max((r.offset + r.length for r in self.reads), default=0),
            "violations": len(of("violation")),
        }


class AuditedFile(io.RawIOBase):
    """A seekable file whose reads pass an auditor first. Reads without a bound are refused."""

    def __init__(self, raw, auditor: RangeAuditor):
        self.raw, self.auditor, self.at = raw, auditor, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.auditor.file_size}[whence]
        self.at = base + offset
        return self.at

    def read(self, size: int = -1) -> bytes:
        if size is None or size < 0:
            raise RangeViolationError("a read needs a bound")
        size = min(size, max(0, self.auditor.file_size - self.at))
        if size:
            self.auditor.record(self.at, size)
        self.raw.seek(self.at)
        got = self.raw.read(size)
        self.at += len(got)
        return got

    def readinto(self, buffer) -> int:
        got = self.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def preflight(requested: Iterable[int], spans: Sequence[Span]) -> None:
    """Requested row groups and spans must be the same set, without repeats, with positive lengths that fit 63 bits."""
    asked = list(requested)
    ids = [s.row_group_id for s in spans]
    if len(set(asked)) != len(asked) or len(set(ids)) != len(ids):
        raise RangeViolationError("a row group is named twice")
    if set(asked) != set(ids):
        raise RangeViolationError(f"requested row groups {sorted(asked)} are not the authorized {sorted(ids)}")
    for s in spans:
        if s.length <= 0 or s.offset < 0 or s.offset + s.length >= 1 << 63:
            raise RangeViolationError(f"row group {s.row_group_id} has no sound byte range")


def row_group_ids(ids: Iterable[int], available: int) -> list[int]:
    """Sorted and each once; none at all, or one that the file lacks, is an error."""
    out = sorted(set(ids))
    if not out:
        raise ValueError("no row groups are asked for")
    if out[0] < 0 or out[-1] >= available:
        raise ValueError(f"row group {out[-1] if out[-1] >= available else out[0]} is out of range: the file has {available}")
    return out


def range_reads(rows: DataFrame) -> DataFrame:
    return rows.select("file_uri", F.col("byte_offset").alias("offset"), F.col("byte_length").alias("length"))


def read_range(path: str, offset: int, length: int) -> bytes:
    """Bytes of a local file, or of one in a store that pyarrow opens by URI; a read beyond its end gives what there is."""
    from ..sources.rowgroups import open_raw

    with open_raw(path)[0] as f:
        f.seek(offset)
        return f.read(length)


def classified(reads: DataFrame, spans: DataFrame, footer_bytes: Column | int, keys: Sequence[str] = ("file_uri",)) -> DataFrame:
    """The auditor over tables: reads (keys, offset, length, file_size, footer_open) with a category each.

    A left join of reads with the spans that hold them whole; a read in several spans stays one row.
    """
    on = [F.col(f"a.{k}") == F.col(f"s.{k}") for k in keys]
    inside = (F.col("s.offset") <= F.col("a.offset")) & (F.col("a.offset") + F.col("a.length") <= F.col("s.offset") + F.col("s.length"))
    numbered = reads.withColumn("_row", F.monotonically_increasing_id())
    held = numbered.alias("a").join(spans.alias("s"), [*on, inside], "left_semi").select(F.col("a._row").alias("_held"))
    joined = numbered.join(held, F.col("_row") == F.col("_held"), "left")
    bounded = (F.col("offset") >= 0) & (F.col("length") >= 0) & (F.col("offset") + F.col("length") <= F.col("file_size"))
    tail = F.col("footer_open") & (F.col("offset") >= F.col("file_size") - footer_bytes)
    kind = F.when(bounded & F.col("_held").isNotNull(), "authorized").when(bounded & tail, "footer").otherwise("violation")
    return joined.withColumn("category", kind).drop("_row", "_held")


def audit_totals(reads: DataFrame, keys: Sequence[str] = ("file_uri",)) -> DataFrame:
    is_ = lambda k: F.col("category") == k
    total = lambda k: F.coalesce(F.sum(F.when(is_(k), F.col("length"))), F.lit(0)).cast("long")
    return reads.groupBy(*keys).agg(
        F.count("*").alias("reads"),
        F.sum("length").cast("long").alias("bytes"),
        F.count_if(is_("authorized")).alias("authorized_reads"),
        total("authorized").alias("authorized_bytes"),
        F.count_if(is_("footer")).alias("footer_reads"),
        total("footer").alias("footer_bytes"),
        F.coalesce(F.max(F.when(is_("footer"), F.col("length"))), F.lit(0)).cast("long").alias("largest_footer_read"),
        F.max("offset").alias("max_offset"),
        F.max(F.col("offset") + F.col("length")).alias("max_end"),
        F.count_if(is_("violation")).alias("violations"),
    )


def preflight_table(requested: DataFrame, spans: DataFrame, keys: Sequence[str] = ("file_uri",)) -> DataFrame:
    """For each file: requested without span, span without request, repeats, unsound lengths, and whether all is well."""
    k = [*keys, "row_group_id"]
    a = requested.groupBy(*k).agg(F.count("*").alias("asked"))
    b = spans.groupBy(*k).agg(F.count("*").alias("granted"), F.count_if((F.col("length") <= 0) | (F.col("offset") < 0)).alias("unsound"))
    both = a.join(b, k, "full_outer")
    out = both.groupBy(*keys).agg(
        F.count_if(F.col("granted").isNull()).alias("not_granted"),
        F.count_if(F.col("asked").isNull()).alias("not_asked"),
        F.count_if((F.col("asked") > 1) | (F.col("granted") > 1)).alias("repeated"),
        F.coalesce(F.sum("unsound"), F.lit(0)).cast("long").alias("unsound"),
    )
    return out.withColumn("ok", F.col("not_granted") + F.col("not_asked") + F.col("repeated") + F.col("unsound") == 0)
