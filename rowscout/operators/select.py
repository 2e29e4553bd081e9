"""Selection of row groups: filters, marked stages, windows and interval joins over catalogs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("time", "coarse", "exact", "velocity")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def identity(robot_id: str | None = None, session_id: str | None = None) -> Column:
    return all_of([F.col(c) == F.lit(v) for c, v in (("robot_id", robot_id), ("session_id", session_id)) if v is not None])


def time_overlap(start: int | Column | None, end: int | Column | None) -> Column:
    """Closed on both ends; an open side (None) matches everything."""
    out = []
    if start is not None:
        out.append(F.col("end_ts_ns") >= start)
    if end is not None:
        out.append(F.col("start_ts_ns") <= end)
    return all_of(out)


def min_velocity(v: float | None, strict: bool = False) -> Column:
    """Row groups that may hold a speed of v."""
    if v is None:
        return F.lit(True)
    return F.col("max_velocity") > F.lit(float(v)) if strict else F.col("max_velocity") >= F.lit(float(v))


def clipped(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows that overlap [start, end], cut to it."""
    return rows.where(time_overlap(start, end)).withColumns(
        {"start_ts_ns": F.greatest("start_ts_ns", F.lit(start)), "end_ts_ns": F.least("end_ts_ns", F.lit(end))}
    )


def marked(candidates: DataFrame, time: Column, coarse: Column, exact: Column, velocity: Column) -> DataFrame:
    """Cumulative stage marks m_time, m_coarse, m_exact and m_velocity on every candidate, in one scan."""
    passed, marks = F.lit(True), {}
    for name, c in zip(STAGES, (time, coarse, exact, velocity), strict=True):
        passed = passed & F.coalesce(c, F.lit(False))
        marks[f"m_{name}"] = passed
    return candidates.withColumns(marks)


def stage_counts(rows: DataFrame) -> DataFrame:
    """candidates and matches of each stage, and what each pruned, as one row."""
    n = rows.agg(F.count("*").alias("candidates"), *(F.count_if(f"m_{s}").alias(f"after_{s}") for s in STAGES))
    less = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return n.select(
        "*",
        less("candidates", "after_time").alias("time_pruned"),
        less("after_time", "after_coarse").alias("coarse_pruned"),
        less("after_time", "after_exact").alias("spatial_pruned"),
        less("after_exact", "after_velocity").alias("velocity_pruned"),
    )


def with_stage_counts(rows: DataFrame) -> DataFrame:
    """Every row with the counts of all, from one broadcast row (so that a limit afterwards does not change them)."""
    return rows.crossJoin(F.broadcast(stage_counts(rows)))


def windows(rows: DataFrame, start: int | None = None, end: int | None = None, keys: Sequence[str] = ("robot_id", "session_id", "file_uri")) -> DataFrame:
    """One window for each robot, session and file: bounds clipped to the query's, number of row groups and bytes."""
    lo, hi = F.min("start_ts_ns"), F.max("end_ts_ns")
    return (
        rows.groupBy(*keys)
        .agg(
            F.min("start_ts_ns").alias("first_ts_ns"),
            (lo if start is None else F.greatest(lo, F.lit(start))).alias("window_start_ns"),
            (hi if end is None else F.least(hi, F.lit(end))).alias("window_end_ns"),
            F.count("*").alias("row_groups"),
            F.sum("byte_length").alias("selected_bytes"),
        )
        .where(F.col("window_start_ns") <= F.col("window_end_ns"))
    )


def window_members(win: DataFrame, rows: DataFrame, extra: Column | None = None, keys: Sequence[str] = ("robot_id", "session_id")) -> DataFrame:
    """Row groups of another catalog that overlap each window (closed), of the same robot and session.

    An equi-join on the keys with the overlap as a residual; adaptive execution broadcasts the windows while they are
    few and splits a session that has very many row groups.
    """
    w, r = win.alias("w"), rows.alias("r")
    on = all_of([F.col(f"w.{k}") == F.col(f"r.{k}") for k in keys])
    on = on & (F.col("r.end_ts_ns") >= F.col("w.window_start_ns")) & (F.col("r.start_ts_ns") <= F.col("w.window_end_ns"))
    got = w.join(r, on)
    if extra is not None:
        got = got.where(extra)
    mine = [F.col(f"w.{c}").alias(f"w_{c}" if c in rows.columns and c not in keys else c) for c in win.columns]
    return got.select(*mine, *(F.col(f"r.{c}") for c in rows.columns if c not in keys))


def channel_match(channels: Sequence[tuple[str, str]], alias: str = "r") -> Column:
    """(modality, stream) pairs; none match if the list is empty."""
    pairs = [(F.col(f"{alias}.modality") == m) & (F.col(f"{alias}.stream_id") == s) for m, s in channels]
    return reduce(lambda a, b: a | b, pairs, F.lit(False))


def top_row_groups(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Row groups by time and number, and of equal ones by robot and session."""
    ordered = rows.orderBy("start_ts_ns", "row_group_id", "robot_id", "session_id")
    return ordered if limit is None else ordered.limit(limit)


def common_window(*catalogs: DataFrame) -> DataFrame:
    """The time that all catalogs cover: greatest first start, least last end; one row."""
    parts = [c.agg(F.min("start_ts_ns").alias(f"s{i}"), F.max("end_ts_ns").alias(f"e{i}")) for i, c in enumerate(catalogs)]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    n = len(parts)
    return one.select(
        (F.greatest(*(f"s{i}" for i in range(n))) if n > 1 else F.col("s0")).alias("start_ts_ns"),
        (F.least(*(f"e{i}" for i in range(n))) if n > 1 else F.col("e0")).alias("end_ts_ns"),
    )
