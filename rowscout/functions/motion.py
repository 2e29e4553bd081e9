"""Kinematics and rotations as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_378_137.0
#: Beyond this cosine of the half-angle a chord stands in for the arc.
NEARLY_PARALLEL = 0.9995
#: A length that is off 1 by no more comes from rounding: dividing by it makes a quaternion no better.
ROUNDING = 1e-15

Quat = Sequence[Column]


def velocity_magnitude(vx: Column, vy: Column, vz: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy + vz * vz)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def quat_dot(p: Quat, q: Quat) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2] + p[3] * q[3]


def quat_norm(q: Quat) -> Column:
    return F.sqrt(quat_dot(q, q))


def quat_normalize(q: Quat) -> list[Column]:
    """Unit quaternion; a zero quaternion raises."""
    n = quat_norm(q)
    ok = F.when(n == 0, F.raise_error(F.lit("quaternion has no length")).cast("double")).otherwise(n)
    return [c / ok for c in q]


def with_slerp(df: DataFrame, p: Quat, q: Quat, t: Column, names: Sequence[str], checked: bool = True, as_given: bool = False) -> DataFrame:
    """df with the shortest-path spherical interpolation between two rotations as unit quaternion columns `names`.

    Both ends are normalized and the target is negated where the ends point away from each other; ends that nearly
    agree are interpolated along the chord. With `checked`, t outside [0, 1] raises. With `as_given`, ends whose length
    is 1 but for ROUNDING are not divided by it: of ends half a turn apart the cosine is 0 but for its last places, and
    these say which way to turn. The steps are columns of their own, one after the other: as one nested expression each
    would repeat the ones before it many times over.
    """
    if checked:
        t = F.when((t >= 0) & (t <= 1), t).otherwise(F.raise_error(F.lit("slerp needs 0 <= t <= 1")).cast("double"))
    c = lambda name: F.col(f"_slerp_{name}")
    add = lambda df, **cols: df.withColumns({f"_slerp_{k}": v for k, v in cols.items()})
    none = lambda n: F.when(n == 0, F.raise_error(F.lit("quaternion has no length")).cast("double")).otherwise(n)
    if as_given:
        none = lambda n, none=none: F.when(F.abs(n - 1) <= ROUNDING, 1.0).otherwise(none(n))
    out = add(df, t=t, na=quat_norm(p), nb=quat_norm(q))
    out = add(out, na=none(c("na")), nb=none(c("nb")))
    out = add(out, **{f"a{i}": x / c("na") for i, x in enumerate(p)}, **{f"b{i}": x / c("nb") for i, x in enumerate(q)})
    out = add(out, d=quat_dot([c(f"a{i}") for i in range(4)], [c(f"b{i}") for i in range(4)]))
    out = add(out, near=F.least(F.abs(c("d")), F.lit(1.0)), sign=F.when(c("d") < 0, -1.0).otherwise(1.0))
    straight = c("near") > NEARLY_PARALLEL
    out = add(out, angle=F.when(straight, 1.0).otherwise(F.acos(c("near"))))
    out = add(
        out,
        wa=F.when(straight, 1 - c("t")).otherwise(F.sin((1 - c("t")) * c("angle")) / F.sin(c("angle"))),
        wb=c("sign") * F.when(straight, c("t")).otherwise(F.sin(c("t") * c("angle")) / F.sin(c("angle"))),
    )
    out = add(out, **{f"m{i}": c("wa") * c(f"a{i}") + c("wb") * c(f"b{i}") for i in range(4)})
    out = add(out, n=quat_norm([c(f"m{i}") for i in range(4)]))
    return out.select(*df.columns, *((c(f"m{i}") / c("n")).alias(n) for i, n in enumerate(names)))


def axis_angle(axis: Sequence[Column], angle: Column) -> list[Column]:
    """Quaternion of a turn by `angle` about a unit axis."""
    s = F.sin(angle / 2)
    return [F.cos(angle / 2), *(c * s for c in axis)]


def rpy_to_quat(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Quaternion of roll about x, then pitch about y, then yaw about z."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return [
        cr * cp * cy + sr * sp * sy,
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
    ]


def mercator(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north in metres by the spherical Mercator projection, true to scale at latitude lat0 (degrees)."""
    scale = F.cos(F.radians(lat0))
    east = scale * EARTH_RADIUS_M * F.radians(lon)
    north = scale * EARTH_RADIUS_M * F.log(F.tan(F.radians(90 + lat) / 2))
    return east, north


def linear_self_check(steps: int = 128) -> float:
    """Greatest error of linear interpolation on a straight line, which it should meet exactly."""
    return max(abs((0.0 + (10.0 - 0.0) * (k / steps)) - 10.0 * k / steps) for k in range(steps + 1))


def slerp_self_check(steps: int = 100, turn: float = math.pi / 2) -> float:
    """Greatest angle error of slerp on a turn of constant angular velocity."""
    half = turn / 2
    worst = 0.0
    for k in range(steps + 1):
        t = k / steps
        w = [math.sin((1 - t) * half) / math.sin(half), math.sin(t * half) / math.sin(half)]
        got = (w[0] + w[1] * math.cos(half), w[1] * math.sin(half))
        worst = max(worst, abs(2 * math.atan2(got[1], got[0]) - t * turn))
    return worst
