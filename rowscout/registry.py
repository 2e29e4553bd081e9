"""The registered queries: every operator on the robot-log views of the benchmark tables, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .functions import spatial, times
from .functions.motion import axis_angle, mercator, rpy_to_quat, with_slerp
from .operators import audit, catalog, gaps, motion, resample, select
from .plans.planner import plan_batch
from .plans.predicate import parse
from .plans.proof import choose_query, common_rows, middle_rows
from .plans.report import CorrectnessReport, combined
from .sources.generic import no_number
from .sources.synthetic import synthetic_pose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = list(V.KEYS)
RG = [*KEYS, "row_group_id"]
DAY = 86_400_000_000_000
START = 1_704_067_200_000_000_000 + 5 * DAY
END = START + 10 * DAY
BOX = (50.0, 200.0, 10.0, 60.0, 2.0, 9.0)
IN_TIME = f"end_ts_ns >= {START} and start_ts_ns <= {END}"
IN_BOX = "max_x >= 50 and min_x <= 200 and max_y >= 10 and min_y <= 60 and max_z >= 2 and min_z <= 9"
HZ = 1 / 3600


def query(sql: str | None = None, plain: bool = False):
    """Registers a function under its name, with SQL that follows the views' CTEs (plain: that stands alone)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if plain else V.SQL + sql
        return f

    return add


POSE_COLS = "start_ts_ns end_ts_ns min_x max_x min_y max_y min_z max_z min_velocity max_velocity row_count".split()
IMU_COLS = "start_ts_ns end_ts_ns min_ax max_ax min_ay max_ay min_az max_az min_gx max_gx min_gy max_gy min_gz max_gz row_count gap_count max_gap_ns nominal_dt_ns".split()
GAP_COLS = "gap_count max_gap_ns max_gap_start_ts_ns max_gap_end_ts_ns nominal_dt_ns".split()


@query(f"select robot_id, session_id, row_group_id, {', '.join(POSE_COLS)}, byte_offset, byte_length from rg_pose")
def catalog_index_pose(spark, sf):
    return V.rg_pose(spark, sf).select(*RG, *POSE_COLS, "byte_offset", "byte_length")


@query(f"select robot_id, session_id, row_group_id, {', '.join(IMU_COLS)}, byte_offset, byte_length from rg_imu")
def catalog_index_imu(spark, sf):
    return V.rg_imu(spark, sf).select(*RG, *IMU_COLS, "byte_offset", "byte_length")


@query("select robot_id, session_id, stream_id, start_ts_ns, end_ts_ns, row_count, byte_length from rg_media")
def catalog_index_media(spark, sf):
    return V.rg_media(spark, sf).select(*KEYS, "stream_id", "start_ts_ns", "end_ts_ns", "row_count", "byte_length")


@query(f"select robot_id, session_id, row_group_id, {', '.join(GAP_COLS)} from pose_gap")
def gap_metadata(spark, sf):
    return gaps.gap_metadata(V.grouped(V.pose_raw(spark, sf)), RG).select(*RG, *GAP_COLS)


@query("""
    , steps as (select robot_id, session_id, row_group_id, timestamp_ns - lag(timestamp_ns) over (
        partition by robot_id, session_id, row_group_id order by event_id) as d from pose_s),
    nominal as (select robot_id, session_id, row_group_id,
        coalesce(round(quantile_cont(d::double, 0.5) filter (d > 0))::bigint, 0) as nominal_dt_ns from steps group by all)
    select robot_id, session_id, row_group_id,
        count(*) filter (d > 0 and d > greatest(1, 5 * nominal_dt_ns)) as gap_count,
        coalesce(max(d) filter (d > 0), 0) as max_interval_ns, nominal_dt_ns
    from steps join nominal using (robot_id, session_id, row_group_id) group by all
""")
def gap_stats_sample(spark, sf):
    return gaps.sample_gap_stats(V.grouped(V.pose_raw(spark, sf)), RG, ["event_id"])


_ID = "select session_id, row_group_id, start_ts_ns, end_ts_ns, byte_length from rg_pose where "
_IDS = ["session_id", "row_group_id", "start_ts_ns", "end_ts_ns", "byte_length"]


@query(_ID + "robot_id = 'robot_3' and session_id = 'session_11'")
def filter_identity(spark, sf):
    return V.rg_pose(spark, sf).where(select.identity("robot_3", "session_11")).select(*_IDS)


@query(_ID + IN_TIME)
def filter_time_overlap(spark, sf):
    return V.rg_pose(spark, sf).where(select.time_overlap(START, END)).select(*_IDS)


@query(_ID + IN_BOX)
def filter_bbox(spark, sf):
    return V.rg_pose(spark, sf).where(spatial.overlaps(BOX)).select(*_IDS)


@query(_ID + "max_velocity >= 0.05")
def filter_min_velocity(spark, sf):
    return V.rg_pose(spark, sf).where(select.min_velocity(0.05)).select(*_IDS)


@query(_ID + f"max_velocity > 0.01 and max_velocity >= 0.02 and {IN_BOX} and {IN_TIME}")
def predicate_conjunction(spark, sf):
    text = (
        "velocity_magnitude > 0.01 AND velocity_magnitude >= 0.02 and "
        f"ST_Intersects(position, bbox(50, 200, 10, 60, 2, 9)) AND time_overlap({START}, {END})"
    )
    return V.rg_pose(spark, sf).where(parse(text).column()).select(*_IDS)


@query(f"select session_id, row_group_id, greatest(start_ts_ns, {START}) as start_ts_ns, least(end_ts_ns, {END}) as end_ts_ns, byte_length from rg_pose where {IN_TIME}")
def clip_windows(spark, sf):
    return select.clipped(V.rg_pose(spark, sf), START, END).select(*_IDS)


#: Hilbert distance in DuckDB: the same steps as a list fold over the bits.
_HILBERT = """
    list_reduce([{{'x': {x}::bigint, 'y': {y}::bigint, 'd': 0::bigint, 's': 0::bigint}}] ||
        list_transform(range(15, -1, -1), lambda b: {{'x': 0::bigint, 'y': 0::bigint, 'd': 0::bigint, 's': (1::bigint << b::int)}}),
        lambda a, p: {{
            'x': case when a.y & p.s > 0 then a.x when a.x & p.s > 0 then 65535 - a.y else a.y end,
            'y': case when a.y & p.s > 0 then a.y when a.x & p.s > 0 then 65535 - a.x else a.x end,
            'd': a.d + p.s * p.s * xor(case when a.x & p.s > 0 then 3 else 0 end, case when a.y & p.s > 0 then 1 else 0 end)::bigint,
            's': p.s}}).d
"""
_Q = "greatest(least(floor({0})::bigint + 32768, 65535), 0)"


@query(
    ", cells as (select event_id, " + _Q.format("x") + " as qx, " + _Q.format("y") + " as qy from pose_raw)"
    "select event_id, qx, qy, " + _HILBERT.format(x="qx", y="qy") + " as hilbert_xy from cells"
)
def hilbert_keys(spark, sf):
    p = V.pose_raw(spark, sf).select("event_id", spatial.quantize(F.col("x")).alias("qx"), spatial.quantize(F.col("y")).alias("qy"))
    return p.withColumn("hilbert_xy", spatial.hilbert(F.col("qx"), F.col("qy")))


_BOXES = "select event_id, floor(value)::bigint % 40 as bx, event_id % 40 as b_y, event_id % 5 as w, event_id % 7 as h from events"


@query(
    f"""with boxes as ({_BOXES}),
    cells as (select event_id, unnest(range(bx, bx + w + 1)) as cx, b_y, h from boxes),
    grid as (select event_id, cx, unnest(range(b_y, b_y + h + 1)) as cy from cells),
    keyed as (select event_id, {_HILBERT.format(x="(cx + 32768)", y="(cy + 32768)")} as d from grid)
    select event_id, min(d) as hilbert_min_xy, max(d) as hilbert_max_xy from keyed group by event_id""",
    plain=True,
)
def hilbert_range(spark, sf):
    e = V.table(spark, sf, "events")
    bx, by = F.floor("value") % 40, F.col("event_id") % 40
    box = spatial.hilbert_range(bx, bx + F.col("event_id") % 5, by, by + F.col("event_id") % 7)
    return e.select("event_id", box.alias("h")).select("event_id", F.col("h.lo").alias("hilbert_min_xy"), F.col("h.hi").alias("hilbert_max_xy"))


SMALL = (60.0, 70.0, 20.0, 30.0, -1.0, 20.0)


@query(
    ", cells as (select *, greatest(least(floor(min_x)::bigint + 32768, 65535), 0) as x0, greatest(least(floor(max_x)::bigint + 32768, 65535), 0) as x1,"
    " greatest(least(floor(min_y)::bigint + 32768, 65535), 0) as y0, greatest(least(floor(max_y)::bigint + 32768, 65535), 0) as y1 from rg_pose),"
    " sized as (select *, (x1 - x0 + 1) * (y1 - y0 + 1) > 1024 as wide from cells),"
    " listed as (select session_id, row_group_id, unnest(range(x0, x1 + 1)) as cx, y0, y1 from sized where not wide),"
    " grid as (select session_id, row_group_id, cx, unnest(range(y0, y1 + 1)) as cy from listed),"
    " keyed as (select session_id, row_group_id, " + _HILBERT.format(x="cx", y="cy") + " as d from grid),"
    " spans as (select session_id, row_group_id, min(d) as lo, max(d) as hi from keyed group by all"
    " union all select session_id, row_group_id, 0, 4294967295 from sized where wide)"
    f" select s.session_id, s.row_group_id, start_ts_ns, end_ts_ns, byte_length from spans s join rg_pose r on s.session_id = r.session_id and"
    f" s.row_group_id = r.row_group_id where lo <= {spatial.hilbert_range_of(*SMALL[:4])[1]} and hi >= {spatial.hilbert_range_of(*SMALL[:4])[0]}"
)
def coarse_spatial_hilbert(spark, sf):
    keyed = catalog.with_spatial_keys(V.rg_pose(spark, sf))
    return keyed.where(spatial.coarse_hilbert(SMALL)).select(*_IDS)


@query(_ID + "floor(max_x) >= 60 and floor(min_x) <= 70 and floor(max_y) >= 20 and floor(min_y) <= 30")
def coarse_spatial_tile(spark, sf):
    return catalog.with_spatial_keys(V.rg_pose(spark, sf)).where(spatial.coarse_tile(SMALL)).select(*_IDS)


@query("select robot_id, (timestamp_ns - timestamp_ns % 3600000000000) as time_bucket_ns, count(*) as samples from pose_raw group by all")
def time_bucket(spark, sf):
    p = V.pose_raw(spark, sf)
    return p.groupBy("robot_id", times.hour_bucket(F.col("timestamp_ns")).alias("time_bucket_ns")).agg(F.count("*").alias("samples"))


@query(f"""
    , m as (select {IN_TIME} as t, floor(max_x) >= 50 and floor(min_x) <= 200 and floor(max_y) >= 10 and floor(min_y) <= 60 as c,
        {IN_BOX} as e, max_velocity >= 0.02 as v from rg_pose)
    select count(*) as candidates, count(*) filter (t) as after_time, count(*) filter (t and c) as after_coarse,
        count(*) filter (t and c and e) as after_exact, count(*) filter (t and c and e and v) as after_velocity,
        count(*) - count(*) filter (t) as time_pruned, count(*) filter (t) - count(*) filter (t and c) as coarse_pruned,
        count(*) filter (t) - count(*) filter (t and c and e) as spatial_pruned,
        count(*) filter (t and c and e) - count(*) filter (t and c and e and v) as velocity_pruned
    from m
""")
def staged_explain(spark, sf):
    keyed = catalog.with_spatial_keys(V.rg_pose(spark, sf))
    rows = select.marked(keyed, select.time_overlap(START, END), spatial.coarse_tile(BOX), spatial.overlaps(BOX), select.min_velocity(0.02))
    return select.stage_counts(rows)


@query(f"""
    , m as (select session_id, row_group_id, {IN_TIME} as t, floor(max_x) >= 50 and floor(min_x) <= 200 and floor(max_y) >= 10 and floor(min_y) <= 60 as c,
        {IN_BOX} as e, max_velocity >= 0.001 as v from rg_pose),
    n as (select count(*) as candidates, count(*) filter (t) as after_time, count(*) filter (t and c) as after_coarse, count(*) filter (t and c and e) as after_exact,
        count(*) filter (t and c and e and v) as after_velocity from m)
    select session_id, row_group_id, n.* from m, n where t and c and e and v
""")
def staged_rows(spark, sf):
    keyed = catalog.with_spatial_keys(V.rg_pose(spark, sf))
    rows = select.marked(keyed, select.time_overlap(START, END), spatial.coarse_tile(BOX), spatial.overlaps(BOX), select.min_velocity(0.001))
    counted = select.with_stage_counts(rows).where("m_velocity")
    return counted.select("session_id", "row_group_id", "candidates", *(f"after_{s}" for s in select.STAGES))


@query("select session_id, row_group_id, start_ts_ns, end_ts_ns, byte_length from rg_pose order by start_ts_ns, row_group_id, robot_id, session_id limit 50")
def top_row_groups(spark, sf):
    return select.top_row_groups(V.rg_pose(spark, sf), 50).select(*_IDS)


_WINDOWS = f"""
    , win as (select robot_id, session_id, greatest(min(start_ts_ns), {START}) as window_start_ns,
        least(max(end_ts_ns), {END}) as window_end_ns, count(*) as row_groups, sum(byte_length)::bigint as selected_bytes
        from rg_pose where {IN_TIME} group by all)
"""


def _windows(spark, sf):
    rows = V.rg_pose(spark, sf).where(select.time_overlap(START, END))
    return select.windows(rows, START, END).select(*KEYS, "window_start_ns", "window_end_ns", "row_groups", "selected_bytes")


@query(_WINDOWS + "select * from win where window_start_ns <= window_end_ns")
def window_groups(spark, sf):
    return _windows(spark, sf)


@query(
    _WINDOWS + "select w.session_id, window_start_ns, window_end_ns, r.row_group_id, r.start_ts_ns, r.end_ts_ns, r.byte_length from win w"
    " join rg_imu r on w.robot_id = r.robot_id and w.session_id = r.session_id and r.end_ts_ns >= window_start_ns and r.start_ts_ns <= window_end_ns"
)
def imu_overlap_join(spark, sf):
    win = _windows(spark, sf).select(*KEYS, "window_start_ns", "window_end_ns")
    imu = V.rg_imu(spark, sf).select(*RG, "start_ts_ns", "end_ts_ns", "byte_length")
    return select.window_members(win, imu).drop("robot_id")


@query(
    _WINDOWS + "select w.session_id, r.stream_id, r.start_ts_ns, r.end_ts_ns, r.byte_length from win w"
    " join rg_media r on w.robot_id = r.robot_id and w.session_id = r.session_id and r.end_ts_ns >= window_start_ns"
    " and r.start_ts_ns <= window_end_ns and r.stream_id = 'cam1'"
)
def media_overlap_join(spark, sf):
    win = _windows(spark, sf).select(*KEYS, "window_start_ns", "window_end_ns")
    got = select.window_members(win, V.rg_media(spark, sf), select.channel_match([("camera", "cam1")]))
    return got.select("session_id", "stream_id", "start_ts_ns", "end_ts_ns", "byte_length")


@query(
    _WINDOWS + ", imu as (select w.session_id, sum(r.byte_length)::bigint as b from win w join rg_imu r on w.robot_id = r.robot_id"
    " and w.session_id = r.session_id and r.end_ts_ns >= window_start_ns and r.start_ts_ns <= window_end_ns group by all)"
    " select sum(selected_bytes)::bigint as pose_bytes, sum(coalesce(b, 0))::bigint as imu_bytes,"
    " (sum(selected_bytes) + sum(coalesce(b, 0)))::bigint as total_bytes, sum(selected_bytes) + sum(coalesce(b, 0)) > 100000 as blocked"
    " from win left join imu using (session_id)"
)
def egress_gate(spark, sf):
    win = _windows(spark, sf)
    imu = select.window_members(win.select(*KEYS, "window_start_ns", "window_end_ns"), V.rg_imu(spark, sf).select(*RG, "start_ts_ns", "end_ts_ns", "byte_length"))
    sums = imu.groupBy("session_id").agg(F.sum("byte_length").alias("b"))
    total = F.sum("selected_bytes") + F.sum(F.coalesce("b", F.lit(0)))
    return win.join(sums, "session_id", "left").agg(
        F.sum("selected_bytes").alias("pose_bytes"), F.sum(F.coalesce("b", F.lit(0))).alias("imu_bytes"), total.alias("total_bytes"), (total > 100_000).alias("blocked")
    )


@query(f"""
    , t as (select *, gap_count > 0 and max_gap_end_ts_ns >= {START} and max_gap_start_ts_ns <= {END} as g from rg_pose where {IN_TIME})
    select robot_id, session_id, count(*) filter (g) as gap_row_groups, coalesce(sum(gap_count) filter (g), 0)::bigint as gap_count,
        coalesce(max(max_gap_ns) filter (g), 0)::bigint as max_gap_ns,
        coalesce(arg_max(max_gap_start_ts_ns, max_gap_ns::hugeint * 10000000000000000000 - start_ts_ns) filter (g), 0) as max_gap_start_ts_ns,
        coalesce(arg_max(max_gap_end_ts_ns, max_gap_ns::hugeint * 10000000000000000000 - start_ts_ns) filter (g), 0) as max_gap_end_ts_ns
    from t group by all
""")
def gap_policy_summary(spark, sf):
    rows = V.rg_pose(spark, sf).where(select.time_overlap(START, END))
    return gaps.gap_summary(rows, KEYS, F.lit(START), F.lit(END))


@query("""
    , s as (select *, lag(end_ts_ns) over w as e, lag(nominal_dt_ns) over w as n from rg_pose
        window w as (partition by robot_id, session_id order by start_ts_ns, row_group_id))
    select session_id, row_group_id, e as gap_start_ts_ns, start_ts_ns as gap_end_ts_ns from s
    where 5 * greatest(n, nominal_dt_ns) > 0 and start_ts_ns - e > 5 * greatest(n, nominal_dt_ns)
""")
def gap_seams(spark, sf):
    return gaps.seam_gaps(V.rg_pose(spark, sf), KEYS).drop("robot_id")


@query(
    _WINDOWS + "select count(*) as windows, sum(row_groups)::bigint as row_groups, sum(selected_bytes)::bigint as selected_bytes,"
    " max(window_end_ns - window_start_ns) as longest_ns, bool_and(window_end_ns > window_start_ns) as all_have_length,"
    " bool_or(row_groups > 3) as any_large from win where window_start_ns <= window_end_ns"
)
def batch_rollup(spark, sf):
    long = F.col("window_end_ns") - F.col("window_start_ns")
    return _windows(spark, sf).agg(
        F.count("*").alias("windows"), F.sum("row_groups").alias("row_groups"), F.sum("selected_bytes").alias("selected_bytes"),
        F.max(long).alias("longest_ns"), F.bool_and(long > 0).alias("all_have_length"), F.bool_or(F.col("row_groups") > 3).alias("any_large"),
    )


@query("select event_id, vx, vy, vz, velocity from pose_s")
def velocity_central(spark, sf):
    return V.pose_s(spark, sf).select("event_id", "vx", "vy", "vz", "velocity")


@query("""
    , d as (select event_id, x, y, z, (timestamp_ns - lag(timestamp_ns) over w) / 1e9::double as b, (lead(timestamp_ns) over w - timestamp_ns) / 1e9::double as f,
        x - lag(x) over w as bx, lead(x) over w - x as fx, y - lag(y) over w as byy, lead(y) over w - y as fy, z - lag(z) over w as bz, lead(z) over w - z as fz
        from pose_raw window w as (partition by robot_id, session_id order by timestamp_ns, event_id))
    select event_id, coalesce(case when b > 0 then bx / b end, case when f > 0 then fx / f end, 0)::double as vx,
        coalesce(case when b > 0 then byy / b end, case when f > 0 then fy / f end, 0)::double as vy,
        coalesce(case when b > 0 then bz / b end, case when f > 0 then fz / f end, 0)::double as vz from d
""")
def velocity_backward(spark, sf):
    return motion.velocity_backward(V.pose_raw(spark, sf), order=("timestamp_ns", "event_id")).select("event_id", "vx", "vy", "vz")


@query("""
    , l as (select robot_id, session_id, timestamp_ns, lag(timestamp_ns) over (partition by robot_id, session_id order by x, event_id) as p from pose_raw)
    select robot_id, session_id, count(*) filter (p is not null and timestamp_ns <= p) as violations from l group by all
""")
def monotonicity_check(spark, sf):
    return motion.time_violations(V.pose_raw(spark, sf), order=("x", "event_id"))


@query(
    """
    with q as (select vec_id, embedding[1]::double as a0, embedding[2]::double as a1, embedding[3]::double as a2, embedding[4]::double as a3,
        embedding[5]::double as b0, embedding[6]::double as b1, embedding[7]::double as b2, embedding[8]::double as b3,
        (vec_id % 11)::double / 10 as t from embeddings),
    n as (select vec_id, t, sqrt(a0*a0 + a1*a1 + a2*a2 + a3*a3) as na, sqrt(b0*b0 + b1*b1 + b2*b2 + b3*b3) as nb, * exclude (vec_id, t) from q),
    u as (select vec_id, t, a0/na as a0, a1/na as a1, a2/na as a2, a3/na as a3, b0/nb as b0, b1/nb as b1, b2/nb as b2, b3/nb as b3 from n),
    d as (select *, a0*b0 + a1*b1 + a2*b2 + a3*b3 as d from u),
    w as (select *, case when d < 0 then -1.0 else 1.0 end as s, least(abs(d), 1.0) as c from d),
    k as (select *, case when c > 0.9995 then 1 - t else sin((1 - t) * acos(c)) / sin(acos(c)) end as wa,
        s * case when c > 0.9995 then t else sin(t * acos(c)) / sin(acos(c)) end as wb from w),
    m as (select vec_id, wa*a0 + wb*b0 as m0, wa*a1 + wb*b1 as m1, wa*a2 + wb*b2 as m2, wa*a3 + wb*b3 as m3 from k),
    r as (select *, sqrt(m0*m0 + m1*m1 + m2*m2 + m3*m3) as n from m)
    select vec_id, round(m0/n, 9) as qw, round(m1/n, 9) as qx, round(m2/n, 9) as qy, round(m3/n, 9) as qz from r
    """,
    plain=True,
)
def quaternion_slerp(spark, sf):
    p = V.quat_pairs(spark, sf)
    names = ["qw", "qx", "qy", "qz"]
    got = with_slerp(p, [F.col(f"a{k}") for k in range(4)], [F.col(f"b{k}") for k in range(4)], F.col("t"), names)
    return got.select("vec_id", *(F.round(c, 9).alias(c) for c in names))


@query("""
    , d as (select session_id, lag(qw) over w * qw + lag(qx) over w * qx + lag(qy) over w * qy + lag(qz) over w * qz as d from pose_raw
        window w as (partition by robot_id, session_id order by timestamp_ns, event_id))
    select session_id, count(*) filter (round(d, 9) < 0) as inversions from d group by all
""")
def quaternion_inversions(spark, sf):
    return motion.quaternion_inversions(V.pose_raw(spark, sf), order=("timestamp_ns", "event_id"), digits=9).drop("robot_id")


@query("select session_id, count(*) filter (abs(sqrt(qw*qw + qx*qx + qy*qy + qz*qz) - 1) > 0.001) as off_norm, round(max(abs(sqrt(qw*qw + qx*qx + qy*qy + qz*qz) - 1)), 6) as worst from pose_raw group by all")
def trust_quaternion_norm(spark, sf):
    return motion.norm_errors(V.pose_raw(spark, sf), ["session_id"]).withColumn("worst", F.round("worst", 6))


@query("select session_id, max(velocity) as max_velocity, count(*) filter (velocity > 0.1) as too_fast, count(*) filter (isnan(velocity) or isinf(velocity)) as not_finite from pose_s group by all")
def trust_max_velocity(spark, sf):
    return motion.speed_errors(V.pose_s(spark, sf), ["session_id"], 0.1)


_GRID = """
    , bounds as (select robot_id, session_id, min(timestamp_ns) as s, max(timestamp_ns) as e from pose_s group by all),
    grid as (select robot_id, session_id, unnest(range(0, (e - s) // 3600000000000 + 1)) as k, s from bounds),
    g as (select robot_id, session_id, k, s + k * 3600000000000 as ts_ns from grid),
    p as (select g.*, a.timestamp_ns as pt, a.x as px, a.y as py, a.z as pz, a.qw as pqw, a.qx as pqx, a.qy as pqy, a.qz as pqz, a.vx as pvx, a.vy as pvy, a.vz as pvz
        from g asof join pose_s a on g.session_id = a.session_id and g.ts_ns >= a.timestamp_ns),
    n as (select p.*, a.timestamp_ns as nt, a.x as nx, a.y as ny, a.z as nz, a.qw as nqw, a.qx as nqx, a.qy as nqy, a.qz as nqz, a.vx as nvx, a.vy as nvy, a.vz as nvz
        from p asof join pose_s a on p.session_id = a.session_id and p.ts_ns <= a.timestamp_ns),
    t as (select *, pt = ts_ns as exact, case when nt > pt then (ts_ns - pt)::double / (nt - pt)::double else 0.0 end::double as t,
        pqw*nqw + pqx*nqx + pqy*nqy + pqz*nqz as d from n),
    w as (select *, case when d < 0 then -1.0 else 1.0 end as f, least(abs(d), 1.0) as c from t),
    k as (select *, case when c > 0.9995 then 1 - t else sin((1 - t) * acos(c)) / sin(acos(c)) end as wa,
        f * case when c > 0.9995 then t else sin(t * acos(c)) / sin(acos(c)) end as wb from w),
    m as (select *, wa*pqw + wb*nqw as mw, wa*pqx + wb*nqx as mx, wa*pqy + wb*nqy as my, wa*pqz + wb*nqz as mz from k),
    pose_tensor as (select session_id, k, ts_ns, px + (nx - px) * t as x, py + (ny - py) * t as y, pz + (nz - pz) * t as z,
        round(case when exact then pqw else mw / sqrt(mw*mw + mx*mx + my*my + mz*mz) end, 8) as qw,
        round(case when exact then pqz else mz / sqrt(mw*mw + mx*mx + my*my + mz*mz) end, 8) as qz,
        pvx + (nvx - pvx) * t as vx, pvy + (nvy - pvy) * t as vy, pvz + (nvz - pvz) * t as vz from m)
"""


def _pose_windows(spark, sf):
    return V.pose_raw(spark, sf).groupBy(*KEYS).agg(F.min("timestamp_ns").alias("start_ts_ns"), F.max("timestamp_ns").alias("end_ts_ns"))


def _pose_tensor(spark, sf):
    return resample.tensorize(V.pose_s(spark, sf), _pose_windows(spark, sf), KEYS, HZ)


@query(_GRID + "select * from pose_tensor")
def resample_pose(spark, sf):
    got = _pose_tensor(spark, sf)
    return got.select("session_id", "k", "ts_ns", "x", "y", "z", F.round("qw", 8).alias("qw"), F.round("qz", 8).alias("qz"), "vx", "vy", "vz")


_IMU = """
    , ip as (select g.session_id, k, ts_ns, a.timestamp_ns as pt, a.ax as pax, a.ay as pay, a.az as paz, a.gx as pgx, a.gy as pgy, a.gz as pgz
        from g asof join imu_s a on g.session_id = a.session_id and g.ts_ns >= a.timestamp_ns),
    iq as (select ip.*, a.timestamp_ns as nt, a.ax as nax, a.ay as nay, a.az as naz, a.gx as ngx, a.gy as ngy, a.gz as ngz
        from ip asof join imu_s a on ip.session_id = a.session_id and ip.ts_ns <= a.timestamp_ns),
    it as (select *, case when nt > pt then (ts_ns - pt)::double / (nt - pt)::double else 0.0 end::double as t from iq),
    imu_tensor as (select session_id, k, ts_ns, pax + (nax - pax) * t as ax, pay + (nay - pay) * t as ay, paz + (naz - paz) * t as az,
        pgx + (ngx - pgx) * t as gx, pgy + (ngy - pgy) * t as gy, pgz + (ngz - pgz) * t as gz from it)
"""


def _imu_tensor(spark, sf):
    return resample.tensorize_imu(V.imu_s(spark, sf), _pose_windows(spark, sf), KEYS, HZ, strict=False)


@query(_GRID + _IMU + "select * from imu_tensor")
def resample_imu(spark, sf):
    return _imu_tensor(spark, sf).drop("robot_id")


@query(_GRID + _IMU + "select session_id, k, p.ts_ns, x, y, z, ax, ay, az, gx, gy, gz from pose_tensor p join imu_tensor i using (session_id, k)")
def pose_imu_tensor(spark, sf):
    both = resample.tensorize_both(V.pose_s(spark, sf), V.imu_s(spark, sf), _pose_windows(spark, sf), KEYS, HZ, strict_imu=False)
    got = resample.assemble(both, None, KEYS, ("pos_xyz", "imu_accel", "imu_gyro"))
    return got.drop("robot_id")


_FLEET = """
    with i as (select unnest(range(0, 5000)) as i), f as (select i, i % 20 as r, i // 20 as k from i),
    fleet as (select 'humanoid_' || lpad((r + 1)::varchar, 2, '0') as robot_id, 'session_' || lpad(i::varchar, 6, '0') as session_id,
        (i % 128)::int as row_group_id, 1700000000000000000 + i * 3600000000000 as start_ts_ns, 1700000000000000000 + (i + 1) * 3600000000000 as end_ts_ns,
        -72 + ((13 * k + 13 * r) % 90) * 1.5::double as min_x, -42 + ((7 * k + 5 * r) % 64)::double as min_y, r, k, i,
        (i % 3) * 0.25::double as min_velocity, 1 + (i % 12)::double as max_velocity, 4096 + 65536 * i as byte_offset from f),
    boxed as (select *, min_x + 1.25::double + (r % 4) * 0.25::double as max_x, min_y + 1.25::double + (k % 4) * 0.25::double as max_y from fleet)
"""


@query(_FLEET + "select robot_id, session_id, row_group_id, start_ts_ns, end_ts_ns, min_x, max_x, min_y, max_y, min_velocity, max_velocity, byte_offset from boxed", plain=True)
def fake_catalog(spark, sf):
    got = catalog.fake_catalog(spark, 5000, 20)
    return got.select(*RG, "start_ts_ns", "end_ts_ns", "min_x", "max_x", "min_y", "max_y", "min_velocity", "max_velocity", "byte_offset")


@query(
    _FLEET + "select count(*) as candidates, count(*) filter (s) as matched, count(*) - count(*) filter (s) as pruned from"
    " (select max_x >= -55 and min_x <= -45 and max_y >= -30 and min_y <= -20 as s from boxed)",
    plain=True,
)
def fake_catalog_bbox(spark, sf):
    keyed = catalog.with_spatial_keys(catalog.fake_catalog(spark, 5000, 20))
    box = (-55.0, -45.0, -30.0, -20.0, -2.0, 4.0)
    rows = select.marked(keyed, F.lit(True), spatial.coarse_hilbert(box), spatial.overlaps(box), F.lit(True))
    return rows.agg(F.count("*").alias("candidates"), F.count_if("m_exact").alias("matched"), (F.count("*") - F.count_if("m_exact")).alias("pruned"))


@query("with s as (select unnest(range(0, 101)) as i) select 1000000000 + i * 10000000 as timestamp_ns, i * 0.02::double as x, round(sin(2 * pi() * (i * 0.01::double)), 9) as y,"
       " 2.0::double as vx, round(cos(2 * pi() * (i * 0.01::double)), 9) as vy from s", plain=True)  # fmt: skip
def synthetic_pose_rows(spark, sf):
    p = synthetic_pose(spark, hz=100, duration_s=1.0, start_ts_ns=1_000_000_000)
    return p.select("timestamp_ns", F.round("x", 12).alias("x"), F.round("y", 9).alias("y"), "vx", F.round("vy", 9).alias("vy"))


ORACLE_SQL["synthetic_pose_rows"] = ORACLE_SQL["synthetic_pose_rows"].replace("i * 0.02::double as x", "round(i * 0.02::double, 12) as x")


@query("""
    , a as (select session_id, row_group_id, byte_length from rg_pose), b as (select session_id, row_group_id, byte_length from rg_imu)
    select * from a union all select * from b union all select * from a
""")
def union_catalogs(spark, sf):
    a, b = (rows.select("session_id", "row_group_id", "byte_length") for rows in (V.rg_pose(spark, sf), V.rg_imu(spark, sf)))
    return a.unionByName(b).unionByName(a)


@query("select robot_id, count(distinct file_uri) as files, min(file_uri) as first_uri from rg_pose group by all")
def distinct_uris(spark, sf):
    return V.rg_pose(spark, sf).groupBy("robot_id").agg(F.count_distinct("file_uri").alias("files"), F.min("file_uri").alias("first_uri"))


@query("select greatest(a.s, b.s, c.s) as start_ts_ns, least(a.e, b.e, c.e) as end_ts_ns from (select min(start_ts_ns) s, max(end_ts_ns) e from rg_pose) a,"
       " (select min(start_ts_ns) s, max(end_ts_ns) e from rg_imu) b, (select min(start_ts_ns) s, max(end_ts_ns) e from rg_media) c")  # fmt: skip
def common_window(spark, sf):
    return select.common_window(V.rg_pose(spark, sf), V.rg_imu(spark, sf), V.rg_media(spark, sf))


@query("""
    , c as (select min(start_ts_ns) as s, max(end_ts_ns) as e from rg_imu),
    n as (select p.session_id, p.row_group_id, p.min_x - 1 as min_x, p.max_x + 1 as max_x, p.max_velocity / 2 as min_velocity,
        row_number() over (partition by robot_id, session_id order by start_ts_ns, row_group_id) as i, count(*) over (partition by robot_id, session_id) as n
        from rg_pose p, c where p.start_ts_ns >= c.s and p.end_ts_ns <= c.e)
    select session_id, row_group_id, min_x, max_x, min_velocity from n where i = ceil(n / 2.0)::bigint
""")
def representative_window(spark, sf):
    rows = common_rows(V.rg_pose(spark, sf), V.rg_imu(spark, sf)).where("start_ts_ns >= _s and end_ts_ns <= _e")
    return middle_rows(rows, KEYS).select("session_id", "row_group_id", (F.col("min_x") - 1).alias("min_x"), (F.col("max_x") + 1).alias("max_x"), (F.col("max_velocity") / 2).alias("min_velocity"))


@query("""
    , c as (select greatest(a.s, b.s) as s, least(a.e, b.e) as e from (select min(start_ts_ns) as s, max(end_ts_ns) as e from rg_pose) a,
        (select min(start_ts_ns) as s, max(end_ts_ns) as e from rg_imu) b),
    n as (select p.*, s, e, row_number() over (order by start_ts_ns, row_group_id, robot_id, session_id) as i, count(*) over () as n
        from rg_pose p, c where p.end_ts_ns >= s and p.start_ts_ns <= e)
    select robot_id, session_id, greatest(start_ts_ns, s) as start_ts_ns, least(end_ts_ns, e) as end_ts_ns, min_x - 1 as min_x, max_x + 1 as max_x,
        min_z - 1 as min_z, max_z + 1 as max_z, max_velocity / 2 as min_velocity from n where i = ceil(n / 2.0)::bigint
""")
def proof_query(spark, sf):
    """The arguments that plans.proof.choose_query takes from the catalogs."""
    got = choose_query(V.rg_pose(spark, sf), V.rg_imu(spark, sf))
    x, z = got["bbox"][:2], got["bbox"][4:]
    row = (got["robot_id"], got["session_id"], got["start_ts_ns"], got["end_ts_ns"], *x, *z, got["min_velocity"])
    return spark.createDataFrame([row], "robot_id string, session_id string, start_ts_ns long, end_ts_ns long, min_x double, max_x double, min_z double, max_z double, min_velocity double")


@query(_WINDOWS + """
    , imu as (select w.session_id, count(*) as n, sum(r.byte_length)::bigint as b from win w join rg_imu r on w.robot_id = r.robot_id
        and w.session_id = r.session_id and r.end_ts_ns >= window_start_ns and r.start_ts_ns <= window_end_ns group by all)
    select count(*) as windows, sum(row_groups)::bigint as pose_row_groups, sum(n)::bigint as imu_row_groups, sum(selected_bytes)::bigint as pose_bytes,
        sum(b)::bigint as imu_bytes, min(window_start_ns) as first_start_ns, max(window_end_ns) as last_end_ns, sum(selected_bytes) + sum(b) > 100000 as blocked,
        (select count(*) from rg_pose) as candidates, (select count(*) from rg_pose) - sum(row_groups)::bigint as time_pruned
    from win join imu using (session_id)
""")
def plan_batch_totals(spark, sf):
    """The planner over the catalogs: a window for each session, its inertial row groups, and the batch's combined report."""
    p = plan_batch(
        catalog=V.rg_pose(spark, sf), imu_catalog=V.rg_imu(spark, sf), start_ts_ns=START, end_ts_ns=END, channels=("pos_xyz", "imu_accel"),
        gap_policy="allow", max_egress_bytes=100_000, spark=spark,
    )
    d = p.diagnostics
    row = (len(p.windows), d.pose_matched_row_groups, d.imu_matched_row_groups, p.authorized_pose_bytes, p.authorized_imu_bytes, min(w.start_ts_ns for w in p.windows),
           max(w.end_ts_ns for w in p.windows), p.blocked_by_egress, d.candidate_row_groups, d.time_pruned_row_groups)
    return spark.createDataFrame([row], "windows long, pose_row_groups long, imu_row_groups long, pose_bytes long, imu_bytes long, first_start_ns long, last_end_ns long, blocked boolean, candidates long, time_pruned long")


@query(_WINDOWS + """
    , r as (select *, window_end_ns - window_start_ns as span from win where window_start_ns <= window_end_ns)
    select sum(row_groups)::bigint as matched, sum(selected_bytes)::bigint as bytes, max(span) as pose_max_gap_ns, arg_max(window_start_ns, span::hugeint * 10000000000000000000 - window_start_ns) as max_gap_start,
        arg_max(window_end_ns, span::hugeint * 10000000000000000000 - window_start_ns) as max_gap_end, bool_or(row_groups > 3) as blocked, bool_and(row_groups > 0) as enforced from r
""")
def batch_report(spark, sf):
    """report.combined over a report for each window: sums, greatest values with their places, any and all."""
    rows = _windows(spark, sf).orderBy(F.desc(F.col("window_end_ns") - F.col("window_start_ns")), "window_start_ns").collect()  # a row for each window of the plan
    reports = [
        CorrectnessReport(pose_max_gap_ns=r["window_end_ns"] - r["window_start_ns"], pose_max_gap_start_ts_ns=r["window_start_ns"], pose_max_gap_end_ts_ns=r["window_end_ns"],
                          matched_row_groups=r["row_groups"], selected_bytes=r["selected_bytes"], blocked_by_egress=r["row_groups"] > 3, range_enforced=r["row_groups"] > 0)
        for r in rows
    ]
    c = combined(reports)
    row = (c.matched_row_groups, c.selected_bytes, c.pose_max_gap_ns, c.pose_max_gap_start_ts_ns, c.pose_max_gap_end_ts_ns, c.blocked_by_egress, c.range_enforced)
    return spark.createDataFrame([row], "matched long, bytes long, pose_max_gap_ns long, max_gap_start long, max_gap_end long, blocked boolean, enforced boolean")


@query("select min(v) as threshold, count(*) as sessions from (select session_id, max(max_velocity) as v from rg_pose group by all)")
def session_velocity_threshold(spark, sf):
    per = V.rg_pose(spark, sf).groupBy("session_id").agg(F.max("max_velocity").alias("v"))
    return per.agg(F.min("v").alias("threshold"), F.count("*").alias("sessions"))


@query("select count(*) as row_groups, coalesce(sum(byte_length), 0)::bigint as bytes, count(*) filter (gap_count > 0) as gap_row_groups, max(max_gap_ns) as max_gap_ns from rg_pose")
def catalog_stats(spark, sf):
    return V.rg_pose(spark, sf).agg(
        F.count("*").alias("row_groups"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"), F.count_if(F.col("gap_count") > 0).alias("gap_row_groups"), F.max("max_gap_ns").alias("max_gap_ns")
    )


@query("select event_id, event_id * 1000000 as exact_ns, round(value::double * 1e9)::bigint as rounded_ns from events", plain=True)
def timestamp_scale(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", times.scaled(F.col("event_id"), 1e6, True).alias("exact_ns"), times.scaled(F.col("value"), 1e9, False).alias("rounded_ns")
    )


@query("select event_type, count(*) filter (try_cast(case when event_id % 3 = 0 then event_type else value::varchar end as double) is null) as bad from events group by all", plain=True)
def try_cast_preflight(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return V.table(spark, sf, "events").groupBy("event_type").agg(F.count_if(no_number(text)).alias("bad"))


@query("""
    , s as (select frame_path, regexp_replace(regexp_replace(string_split(frame_path, '/')[-1], '\\.[^.]*$', ''), '[^0-9]', '', 'g') as d from media_s)
    select frame_path, case when length(d) >= 6 then try_cast(d as bigint) end as timestamp from s
""")
def filename_timestamp(spark, sf):
    return V.media_s(spark, sf).select("frame_path", times.filename_digits(F.col("frame_path")).alias("timestamp"))


@query(
    """with j as (select event_id, json_object('header', json_object('stamp', json_object('sec', event_id % 1000, 'nanosec', event_id % 7)),
        'pose', json_object('position', json_object('x', value, 'y', 1.5, 'z', 0.0)), 'timestamp_ns', case when event_id % 4 = 0 then event_id end) as j from events)
    select event_id, coalesce((j->>'timestamp_ns')::bigint, (j->'header'->'stamp'->>'sec')::bigint * 1000000000 + (j->'header'->'stamp'->>'nanosec')::bigint) as timestamp_ns,
        (j->'pose'->'position'->>'x')::double as x, (j->'pose'->'position'->>'y')::double as y from j""",
    plain=True,
)
def json_pose_decode(spark, sf):
    from .sources.mcap import json_pose_columns

    e = V.table(spark, sf, "events")
    stamp = F.struct((F.col("event_id") % 1000).alias("sec"), (F.col("event_id") % 7).alias("nanosec"))
    place = F.struct(F.col("value").alias("x"), F.lit(1.5).alias("y"), F.lit(0.0).alias("z"))
    turn = F.struct(*(F.lit(v).alias(c) for c, v in (("x", 0.0), ("y", 0.0), ("z", 0.0), ("w", 1.0))))
    body = F.struct(
        F.struct(stamp.alias("stamp")).alias("header"),
        F.struct(place.alias("position"), turn.alias("orientation")).alias("pose"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("timestamp_ns"),
    )
    sent = e.select("event_id", F.to_json(body).alias("j"))
    cols = json_pose_columns(F.col("j"), F.lit(0))
    return sent.select("event_id", cols["timestamp_ns"].alias("timestamp_ns"), cols["x"].alias("x"), cols["y"].alias("y"))


@query(
    """with p as (select event_id, 48 + value / 100 as lat, 8 + (event_id % 100) / 1000.0::double as lon, (event_id % 628) / 100.0::double as yaw from events)
    select event_id, round(cos(radians(49.0::double)) * 6378137 * radians(lon), 5) as east,
        round(cos(radians(49.0::double)) * 6378137 * ln(tan(radians(90 + lat) / 2)), 5) as north,
        round(cos(yaw / 2), 9) as qw, round(sin(yaw / 2), 9) as qz from p""",
    plain=True,
)
def kitti_local_frame(spark, sf):
    e = V.table(spark, sf, "events").select(
        "event_id", (48 + F.col("value") / 100).alias("lat"), (8 + (F.col("event_id") % 100) / 1000).alias("lon"), ((F.col("event_id") % 628) / 100).alias("yaw")
    )
    east, north = mercator(F.col("lat"), F.col("lon"), F.lit(49.0))
    q = rpy_to_quat(F.lit(0.0), F.lit(0.0), F.col("yaw"))
    return e.select("event_id", F.round(east, 5).alias("east"), F.round(north, 5).alias("north"), F.round(q[0], 9).alias("qw"), F.round(q[3], 9).alias("qz"))


@query("with p as (select event_id, (event_id % 628) / 100.0::double as a from events) select event_id, round(cos(a / 2), 9) as qw, round(sin(a / 2) * 0.6, 9) as qx,"
       " round(sin(a / 2) * 0.8, 9) as qy from p", plain=True)  # fmt: skip
def axis_angle_quaternion(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", ((F.col("event_id") % 628) / 100).alias("a"))
    q = axis_angle([F.lit(0.6), F.lit(0.8), F.lit(0.0)], F.col("a"))
    return e.select("event_id", *(F.round(c, 9).alias(n) for c, n in zip(q[:3], ("qw", "qx", "qy"), strict=True)))


_READS = "select l_orderkey as read_id, l_orderkey % 50 as file_id, (l_partkey * 7) % 1000 as o, l_linenumber * 10 as n from lineitem"


@query(
    f"""with r as ({_READS}), c as (select file_id, n, o, case when o + n > 1000 then 'violation'
        when (o >= 100 and o + n <= 400) or (o >= 350 and o + n <= 600) then 'authorized'
        when file_id % 2 = 0 and o >= 800 then 'footer' else 'violation' end as category from r)
    select file_id, count(*) as reads, sum(n)::bigint as bytes, count(*) filter (category = 'authorized') as authorized_reads,
        coalesce(sum(n) filter (category = 'authorized'), 0)::bigint as authorized_bytes, count(*) filter (category = 'footer') as footer_reads,
        coalesce(sum(n) filter (category = 'footer'), 0)::bigint as footer_bytes, coalesce(max(n) filter (category = 'footer'), 0)::bigint as largest_footer_read,
        max(o) as max_offset, max(o + n) as max_end, count(*) filter (category = 'violation') as violations from c group by all""",
    plain=True,
)
def range_audit_classify(spark, sf):
    l = V.table(spark, sf, "lineitem")
    reads = l.select(
        (F.col("l_orderkey") % 50).alias("file_id"), ((F.col("l_partkey") * 7) % 1000).alias("offset"), (F.col("l_linenumber") * 10).cast("long").alias("length"),
        F.lit(1000).alias("file_size"), (F.col("l_orderkey") % 100 % 2 == 0).alias("footer_open"),
    )
    spans = spark.range(50).select(F.col("id").alias("file_id"), F.explode(F.array(F.struct(F.lit(100).alias("o"), F.lit(300).alias("n")), F.struct(F.lit(350).alias("o"), F.lit(250).alias("n")))).alias("s"))
    spans = spans.select("file_id", F.col("s.o").alias("offset"), F.col("s.n").alias("length"))
    return audit.audit_totals(audit.classified(reads, spans, 200, ["file_id"]), ["file_id"])


@query(
    """with q as (select o_custkey // 10 as file_id, o_orderkey % 30 as row_group_id, count(*) as asked from orders where o_orderkey % 3 = 0 group by all),
    s as (select o_custkey // 10 as file_id, o_orderkey % 30 as row_group_id, count(*) as granted, count(*) filter (o_custkey % 17 = 0) as unsound from orders where o_orderkey % 5 = 0 group by all),
    b as (select coalesce(q.file_id, s.file_id) as file_id, asked, granted, unsound from q full join s on q.file_id = s.file_id and q.row_group_id = s.row_group_id)
    select file_id, count(*) filter (granted is null) as not_granted, count(*) filter (asked is null) as not_asked, count(*) filter (asked > 1 or granted > 1) as repeated,
        coalesce(sum(unsound), 0)::bigint as unsound, count(*) filter (granted is null) + count(*) filter (asked is null) + count(*) filter (asked > 1 or granted > 1) + coalesce(sum(unsound), 0) = 0 as ok
    from b group by all""",
    plain=True,
)
def range_audit_preflight(spark, sf):
    o = V.table(spark, sf, "orders")
    ids = [F.expr("o_custkey div 10").alias("file_id"), (F.col("o_orderkey") % 30).alias("row_group_id")]  # files grow with the table
    asked = o.where("o_orderkey % 3 = 0").select(*ids)
    spans = o.where("o_orderkey % 5 = 0").select(*ids, F.lit(0).alias("offset"), F.when(F.col("o_custkey") % 17 == 0, 0).otherwise(10).alias("length"))
    return audit.preflight_table(asked, spans, ["file_id"])


@query("select session_id, stream_id, count(*) as frames, sum(bytes)::bigint as bytes, min(frame_path) as first_path from media_s group by all")
def media_frame_bytes(spark, sf):
    return V.media_s(spark, sf).groupBy("session_id", "stream_id").agg(
        F.count("*").alias("frames"), F.sum(F.octet_length("camera_bytes")).cast("long").alias("bytes"), F.min("frame_path").alias("first_path")
    )
