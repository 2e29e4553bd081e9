"""Time in nanoseconds: never through TIMESTAMP (microseconds) and only on request through DOUBLE."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
#: Nanoseconds in each unit a mapping can name.
UNIT_NS = {
    "ns": 1, "nanosecond": 1, "nanoseconds": 1, "us": 1_000, "microsecond": 1_000, "microseconds": 1_000,
    "ms": 1_000_000, "millisecond": 1_000_000, "milliseconds": 1_000_000,
    "s": 1_000_000_000, "sec": 1_000_000_000, "second": 1_000_000_000, "seconds": 1_000_000_000,
}


def ntz_to_ns(ts: str) -> Column:
    """Nanoseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) * 1000")


def hour_bucket(ts: Column) -> Column:
    """The beginning of the hour, exact for negative times too."""
    return ts - F.pmod(ts, F.lit(HOUR_NS))


def grid_step(hz: float) -> int:
    if not hz > 0:
        raise ValueError("target_hz must be positive")
    step = int(1e9 / hz + 0.5)
    if step <= 0:
        raise ValueError("target_hz is too high for nanoseconds")
    return step


def scaled(column: Column, scale: float, integral: bool) -> Column:
    """Nanoseconds of a time column in units of `scale` ns: exact for integers and whole scales, else by doubles."""
    if integral and float(scale).is_integer():
        return column.cast("long") * F.lit(int(scale)).cast("long")
    return F.round(column.cast("double") * F.lit(float(scale))).cast("long")


#: What says a unit anywhere in a column's name, asked in this order; seconds also by a name that ends in _s.
UNIT_MARKS = {"ns": ("ns", "nanosecond"), "us": ("us", "microsecond"), "ms": ("ms", "millisecond"), "s": ("seconds",)}


def unit_of_name(name: str) -> str:
    """Unit that a column name suggests by UNIT_MARKS; a name that says nothing is taken as nanoseconds."""
    low = name.lower()
    said = [unit for unit, marks in UNIT_MARKS.items() if any(m in low for m in marks)]
    return said[0] if said else "s" if low.endswith("_s") else "ns"


def scale_of(options: dict, column: str = "") -> float:
    """timestamp_scale, else timestamp_unit, else the discovered unit, else what the name suggests."""
    if options.get("timestamp_scale") is not None:
        scale = float(options["timestamp_scale"])
        if scale <= 0:
            raise ValueError("timestamp_scale must be positive")
        return scale
    found = options.get("discovery") or {}
    unit = options.get("timestamp_unit") or found.get("timestamp_unit") or (unit_of_name(column) if column else "ns")
    if str(unit).lower() not in UNIT_NS:
        raise ValueError(f"unknown timestamp unit {unit!r}")
    return float(UNIT_NS[str(unit).lower()])


def filename_digits(path: Column) -> Column:
    """All digits of a file name's stem as BIGINT; null if they are fewer than six."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    digits = F.regexp_replace(stem, "[^0-9]", "")
    return F.when(F.length(digits) >= 6, digits).try_cast("long")


def filename_digits_of(name: str) -> int | None:
    digits = re.sub("[^0-9]", "", name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return int(digits) if len(digits) >= 6 else None


def datetime_text_to_ns(text: Column) -> Column:
    """UTC nanoseconds of `2011-09-26 13:02:25.000000001`."""
    whole = F.split(text, r"\.")
    seconds = F.unix_seconds(F.to_timestamp(F.concat(whole[0], F.lit("+00:00")), "yyyy-MM-dd HH:mm:ssXXX"))
    fraction = F.rpad(F.substring(F.coalesce(F.get(whole, F.lit(1)), F.lit("0")), 1, 9), 9, "0").cast("long")
    return seconds * 1_000_000_000 + fraction
