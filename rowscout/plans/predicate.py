"""The predicate language: conjunctions of speed, box and time terms, parsed to columns, never to SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spatial import overlaps
from ..operators.select import all_of, time_overlap

_NUMBER = r"(-?\d+(?:\.\d+)?)"
_SPEED = re.compile(rf"velocity_magnitude\s*(>=|>)\s*{_NUMBER}", re.IGNORECASE)
_BOX = re.compile(rf"ST_Intersects\(\s*position\s*,\s*bbox\(\s*{r'\s*,\s*'.join([_NUMBER] * 6)}\s*\)\s*\)", re.IGNORECASE)
_TIME = re.compile(r"time_overlap\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)", re.IGNORECASE)


@dataclass
class Predicate:
    speeds: list[tuple[str, float]] = field(default_factory=list)
    boxes: list[tuple[float, ...]] = field(default_factory=list)
    times: list[tuple[int, int]] = field(default_factory=list)

    @property
    def min_velocity(self) -> float | None:
        """The threshold to report: the greatest of all."""
        return max((v for _, v in self.speeds), default=None)

    def velocity(self) -> Column:
        top = F.col("max_velocity")
        return all_of([top > F.lit(v) if op == ">" else top >= F.lit(v) for op, v in self.speeds])

    def spatial(self) -> Column:
        return all_of([overlaps(b) for b in self.boxes])

    def time(self) -> Column:
        return all_of([time_overlap(s, e) for s, e in self.times])

    def column(self) -> Column:
        return all_of([self.time(), self.spatial(), self.velocity()])


def parse(text: str | None) -> Predicate:
    """Terms joined by AND (any case); anything that is not one of the three forms raises ValueError."""
    out = Predicate()
    if text is None or not text.strip():
        return out
    for term in re.split(r"\s+AND\s+", text.strip(), flags=re.IGNORECASE):
        term = term.strip()
        if m := _SPEED.fullmatch(term):
            out.speeds.append((m[1], float(m[2])))
        elif m := _BOX.fullmatch(term):
            out.boxes.append(tuple(map(float, m.groups())))
        elif m := _TIME.fullmatch(term):
            start, end = int(m[1]), int(m[2])
            if start > end:
                raise ValueError("time_overlap starts after it ends")
            out.times.append((start, end))
        else:
            raise ValueError(f"unsupported predicate expression: {term!r}")
    return out
