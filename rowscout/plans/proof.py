"""Proof queries and gates: a query that should match, chosen from the catalogs, and thresholds on how it runs."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.select import common_window
from .planner import plan_batch, session


def common_rows(pose: DataFrame, *others: DataFrame) -> DataFrame:
    """Row groups of pose with the time that all the other catalogs cover, in _s and _e."""
    span = common_window(*others).select(F.col("start_ts_ns").alias("_s"), F.col("end_ts_ns").alias("_e"))  # one row
    return pose.crossJoin(F.broadcast(span))


def middle_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The middle row group of each group by time: of n the one at place ceil(n / 2)."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_i": F.row_number().over(w.orderBy("start_ts_ns", "row_group_id")), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_i") == F.ceil(F.col("_n") / 2)).drop("_i", "_n")


def middle_row(rows: DataFrame):
    """The middle row group of all, without ranking them in one task: its start is an exact median, and only row groups of
    that start are put in order. None of an empty table."""
    told = rows.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by start_ts_ns)").alias("start")).first()
    if not told["n"]:
        return None
    place = -(-told["n"] // 2) - rows.where(F.col("start_ts_ns") < told["start"]).count()
    return rows.where(F.col("start_ts_ns") == told["start"]).orderBy("row_group_id", "robot_id", "session_id").limit(place).tail(1)[0]


def choose_query(pose: DataFrame, *others: DataFrame, pad: float = 1.0) -> dict[str, object]:
    """Arguments of plan() that the middle row group of the time that all catalogs cover must match: its window, its box
    with a margin, and half its top speed."""
    row = middle_row(common_rows(pose, pose, *others).where((F.col("end_ts_ns") >= F.col("_s")) & (F.col("start_ts_ns") <= F.col("_e"))))
    if row is None:
        raise LookupError("the catalogs share no time")
    box = tuple(v for a in "xyz" for v in (row[f"min_{a}"] - pad, row[f"max_{a}"] + pad))
    return {
        "robot_id": row["robot_id"],
        "session_id": row["session_id"],
        "start_ts_ns": max(row["start_ts_ns"], row["_s"]),
        "end_ts_ns": min(row["end_ts_ns"], row["_e"]),
        "bbox": box,
        "min_velocity": row["max_velocity"] / 2,
    }


def percentile(values: Sequence[float], share: float) -> float:
    """Nearest rank, by rounding the place among the sorted values."""
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, max(0, round(share * (len(ordered) - 1))))]


@dataclass
class GateReport:
    p50_ms: float
    p95_ms: float
    mean_ms: float
    prune_ratio: float
    authorized_bytes: int
    failures: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.failures


def gate(
    options: dict,
    *,
    iterations: int = 20,
    warm_up: int = 3,
    max_p95_ms: float = math.inf,
    min_prune_ratio: float = 0.0,
    max_authorized_bytes: float = math.inf,
    spark: SparkSession | None = None,
) -> GateReport:
    """Plans the same query again and again and holds latency, pruning and authorised bytes against thresholds."""
    spark = session(spark)
    times = []
    for k in range(iterations + warm_up):
        began = time.perf_counter()
        p = plan_batch(spark=spark, **options)
        if k >= warm_up:
            times.append((time.perf_counter() - began) * 1000)
    d = p.diagnostics
    ratio = 1 - d.pose_matched_row_groups / d.candidate_row_groups if d.candidate_row_groups else 0.0
    out = GateReport(percentile(times, 0.5), percentile(times, 0.95), sum(times) / len(times), ratio, p.authorized_total_bytes)
    for bad, text in (
        (out.p95_ms > max_p95_ms, f"p95 {out.p95_ms:.1f} ms is over {max_p95_ms}"),
        (ratio < min_prune_ratio, f"prune ratio {ratio:.3f} is under {min_prune_ratio}"),
        (out.authorized_bytes > max_authorized_bytes, f"{out.authorized_bytes} authorised bytes are over {max_authorized_bytes}"),
    ):
        if bad:
            out.failures.append(text)
    return out
