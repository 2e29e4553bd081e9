"""Robot-log views of the benchmark tables, so that every operator can run, and be checked, on them.

Events become pose samples (view, click, signup) and inertial samples (purchase, error) of sessions, one for each user;
pages become camera frames; embeddings become pairs of quaternions. Row groups are virtual: 16 samples each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.motion import velocity_magnitude
from .functions.times import ntz_to_ns
from .operators.catalog import from_samples
from .operators.motion import velocity_central

ROWS = 16
KEYS = ("robot_id", "session_id")
POSE_BYTES, IMU_BYTES = 112, 72


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    return e.select(
        ntz_to_ns("ts").alias("timestamp_ns"),
        F.concat(F.lit("robot_"), F.col("user_id") % 8).alias("robot_id"),
        F.concat(F.lit("session_"), F.col("user_id")).alias("session_id"),
        "event_id",
        "user_id",
        "value",
    )


def pose_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses without velocity."""
    half = F.radians((F.col("event_id") % 360).cast("double")) / 2
    return _events(spark, sf_dir, ("view", "click", "signup")).select(
        "timestamp_ns",
        *KEYS,
        "event_id",
        F.col("value").alias("x"),
        (F.col("event_id") % 97).cast("double").alias("y"),
        (F.col("user_id") % 13).cast("double").alias("z"),
        F.cos(half).alias("qw"),
        F.lit(0.0).alias("qx"),
        F.lit(0.0).alias("qy"),
        F.sin(half).alias("qz"),
    )


def pose_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = velocity_central(pose_raw(spark, sf_dir), KEYS, ("timestamp_ns", "event_id"))
    return out.withColumn("velocity", velocity_magnitude(F.col("vx"), F.col("vy"), F.col("vz")))


def imu_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir, ("purchase", "error")).select(
        "timestamp_ns",
        *KEYS,
        "event_id",
        F.col("value").alias("ax"),
        (e % 7).cast("double").alias("ay"),
        F.lit(9.81).alias("az"),
        *((e % m).cast("double").alias(c) for c, m in (("gx", 11), ("gy", 13), ("gz", 17))),
    )


def media_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the robots and sessions that the events have, over the same thirty days."""
    p = table(spark, sf_dir, "pages")
    start = 1_704_067_200_000_000_000
    user = F.col("page_id") % 150
    return p.select(
        (F.lit(start) + F.col("page_id") * 37 % 720 * 3_600_000_000_000).alias("timestamp_ns"),
        F.concat(F.lit("robot_"), user % 8).alias("robot_id"),
        F.concat(F.lit("session_"), user).alias("session_id"),
        F.concat(F.lit("cam"), F.col("page_id") % 2).alias("stream_id"),
        F.concat(F.lit("frames/"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".png")).alias("frame_path"),
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("camera_bytes"),
    )


def grouped(samples: DataFrame, order: tuple[str, ...] = ("timestamp_ns", "event_id")) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy(*order)
    return samples.withColumn("row_group_id", F.floor((F.row_number().over(w) - 1) / ROWS).cast("int"))


def _catalog(samples: DataFrame, ranges: tuple[str, ...], row_bytes: int, kind: str) -> DataFrame:
    rows = from_samples(grouped(samples), [*KEYS, "row_group_id"], ranges)
    w = Window.partitionBy(*KEYS).orderBy("row_group_id").rowsBetween(Window.unboundedPreceding, -1)
    size = (F.col("row_count") * row_bytes).cast("long")
    return rows.withColumn("byte_length", size).withColumns(
        {
            "byte_offset": F.coalesce(F.sum("byte_length").over(w), F.lit(0)).cast("long"),
            "file_uri": F.concat(F.lit(f"mem://{kind}/"), F.col("session_id"), F.lit(".parquet")),
        }
    )


def rg_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(pose_s(spark, sf_dir), ("x", "y", "z", "velocity"), POSE_BYTES, "pose")


def rg_imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(imu_s(spark, sf_dir), ("ax", "ay", "az", "gx", "gy", "gz"), IMU_BYTES, "imu")


def rg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row group for each session and stream."""
    return (
        media_s(spark, sf_dir)
        .groupBy(*KEYS, "stream_id")
        .agg(
            F.min("timestamp_ns").alias("start_ts_ns"),
            F.max("timestamp_ns").alias("end_ts_ns"),
            F.count("*").alias("row_count"),
            F.sum(F.octet_length("camera_bytes")).cast("long").alias("byte_length"),
        )
        .withColumns({"modality": F.lit("camera"), "row_group_id": F.lit(0)})
    )


def quat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return e.select(
        "vec_id", *(part(k).alias(f"a{k}") for k in range(4)), *(part(k + 4).alias(f"b{k}") for k in range(4)),
        ((F.col("vec_id") % 11) / 10).alias("t"),
    )


#: The same views as DuckDB CTEs.
SQL = """
with pose_raw as (
    select epoch_us(ts) * 1000 as timestamp_ns, 'robot_' || (user_id % 8) as robot_id, 'session_' || user_id as session_id,
        event_id, value as x, (event_id % 97)::double as y, (user_id % 13)::double as z,
        cos(radians((event_id % 360)::double) / 2) as qw, 0.0::double as qx, 0.0::double as qy,
        sin(radians((event_id % 360)::double) / 2) as qz
    from events where event_type in ('view', 'click', 'signup')
),
pose_d as (
    select *, (coalesce(lead(timestamp_ns) over w, timestamp_ns) - coalesce(lag(timestamp_ns) over w, timestamp_ns)) / 1e9::double as dt,
        coalesce(lead(x) over w, x) - coalesce(lag(x) over w, x) as dx,
        coalesce(lead(y) over w, y) - coalesce(lag(y) over w, y) as dy,
        coalesce(lead(z) over w, z) - coalesce(lag(z) over w, z) as dz,
        ((row_number() over w - 1) // 16)::int as row_group_id
    from pose_raw window w as (partition by robot_id, session_id order by timestamp_ns, event_id)
),
pose_v as (
    select *, case when dt > 0 then dx / dt else 0.0 end::double as vx, case when dt > 0 then dy / dt else 0.0 end::double as vy,
        case when dt > 0 then dz / dt else 0.0 end::double as vz
    from pose_d
),
pose_s as (select *, sqrt(vx * vx + vy * vy + vz * vz) as velocity from pose_v),
imu_s as (
    select epoch_us(ts) * 1000 as timestamp_ns, 'robot_' || (user_id % 8) as robot_id, 'session_' || user_id as session_id, event_id,
        value as ax, (event_id % 7)::double as ay, 9.81::double as az, (event_id % 11)::double as gx, (event_id % 13)::double as gy,
        (event_id % 17)::double as gz,
        ((row_number() over (partition by user_id order by ts, event_id) - 1) // 16)::int as row_group_id
    from events where event_type in ('purchase', 'error')
),
media_s as (
    select 1704067200000000000 + (page_id * 37 % 720) * 3600000000000 as timestamp_ns, 'robot_' || (page_id % 150 % 8) as robot_id,
        'session_' || (page_id % 150) as session_id, 'cam' || (page_id % 2) as stream_id,
        'frames/' || lpad(page_id::varchar, 9, '0') || '.png' as frame_path, octet_length(encode(coalesce(html, ''))) as bytes
    from pages
),
pose_steps as (
    select robot_id, session_id, row_group_id, timestamp_ns, lag(timestamp_ns) over w as prev, timestamp_ns - lag(timestamp_ns) over w as d
    from pose_s window w as (partition by robot_id, session_id, row_group_id order by timestamp_ns)
),
imu_steps as (
    select robot_id, session_id, row_group_id, timestamp_ns, lag(timestamp_ns) over w as prev, timestamp_ns - lag(timestamp_ns) over w as d
    from imu_s window w as (partition by robot_id, session_id, row_group_id order by timestamp_ns)
),
pose_nominal as (
    select robot_id, session_id, row_group_id, coalesce(round(quantile_cont(d::double, 0.5) filter (d > 0))::bigint, 0) as nominal_dt_ns
    from pose_steps group by all
),
imu_nominal as (
    select robot_id, session_id, row_group_id, coalesce(round(quantile_cont(d::double, 0.5) filter (d > 0))::bigint, 0) as nominal_dt_ns
    from imu_steps group by all
),
pose_gap as (
    select robot_id, session_id, row_group_id, n.nominal_dt_ns, count(*) filter (d > 0 and d > greatest(1, 5 * nominal_dt_ns)) as gap_count,
        coalesce(max(d) filter (d > 0 and d > greatest(1, 5 * nominal_dt_ns)), 0) as max_gap_ns,
        coalesce(arg_max(prev, d::hugeint * 10000000000000000000 - prev) filter (d > 0 and d > greatest(1, 5 * nominal_dt_ns)), 0) as max_gap_start_ts_ns,
        coalesce(arg_max(timestamp_ns, d::hugeint * 10000000000000000000 - prev) filter (d > 0 and d > greatest(1, 5 * nominal_dt_ns)), 0) as max_gap_end_ts_ns
    from pose_steps join pose_nominal n using (robot_id, session_id, row_group_id) group by all
),
imu_gap as (
    select robot_id, session_id, row_group_id, n.nominal_dt_ns, count(*) filter (d > 0 and d > greatest(1, 5 * nominal_dt_ns)) as gap_count,
        coalesce(max(d) filter (d > 0 and d > greatest(1, 5 * nominal_dt_ns)), 0) as max_gap_ns
    from imu_steps join imu_nominal n using (robot_id, session_id, row_group_id) group by all
),
pose_stats as (
    select robot_id, session_id, row_group_id, min(timestamp_ns) as start_ts_ns, max(timestamp_ns) as end_ts_ns,
        min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z,
        min(velocity) as min_velocity, max(velocity) as max_velocity, count(*) as row_count, 112 * count(*) as byte_length
    from pose_s group by all
),
rg_pose as (
    select *, coalesce(sum(byte_length) over (partition by robot_id, session_id order by row_group_id
            rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset,
        'mem://pose/' || session_id || '.parquet' as file_uri
    from pose_stats join pose_gap using (robot_id, session_id, row_group_id)
),
imu_stats as (
    select robot_id, session_id, row_group_id, min(timestamp_ns) as start_ts_ns, max(timestamp_ns) as end_ts_ns,
        min(ax) as min_ax, max(ax) as max_ax, min(ay) as min_ay, max(ay) as max_ay, min(az) as min_az, max(az) as max_az,
        min(gx) as min_gx, max(gx) as max_gx, min(gy) as min_gy, max(gy) as max_gy, min(gz) as min_gz, max(gz) as max_gz,
        count(*) as row_count, 72 * count(*) as byte_length
    from imu_s group by all
),
rg_imu as (
    select *, coalesce(sum(byte_length) over (partition by robot_id, session_id order by row_group_id
        rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset
    from imu_stats join imu_gap using (robot_id, session_id, row_group_id)
),
rg_media as (
    select robot_id, session_id, stream_id, min(timestamp_ns) as start_ts_ns, max(timestamp_ns) as end_ts_ns, count(*) as row_count,
        sum(bytes)::bigint as byte_length
    from media_s group by all
)
"""
