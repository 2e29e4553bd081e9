"""Row-group catalogs: what a query needs to know of each row group without reading it.

Rows come from Parquet footers (bytes exactly as stored) or from samples that carry a row-group number. Footers are read
from local paths and from every store that pyarrow opens by URI; elsewhere `from_samples` gives the same rows but for
bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spatial import hilbert, hilbert_range, quantize, tile
from ..functions.times import hour_bucket
from ..schemas import IMU_CATALOG_SCHEMA, MEDIA_CATALOG_SCHEMA, POSE_CATALOG_SCHEMA, typed
from ..sources.rowgroups import open_raw
from .gaps import gap_metadata

POSE_RANGES = ("x", "y", "z", "velocity")
IMU_RANGES = ("ax", "ay", "az", "gx", "gy", "gz")


def from_samples(samples: DataFrame, keys: Sequence[str], ranges: Sequence[str], threshold_ns: int | None = None) -> DataFrame:
    """keys, start_ts_ns, end_ts_ns, min and max of the ranges, row_count and the gap columns of each row group.

    Both aggregates and the gap windows are partitioned by the keys, so the samples are shuffled once.
    """
    keys = list(keys)
    stats = samples.groupBy(*keys).agg(
        F.min("timestamp_ns").alias("start_ts_ns"),
        F.max("timestamp_ns").alias("end_ts_ns"),
        *(f(c).alias(f"{n}_{c}") for c in ranges for n, f in (("min", F.min), ("max", F.max))),
    )
    return stats.join(gap_metadata(samples, keys, threshold_ns=threshold_ns), keys)


def footer_rows(path: str, ranges: Sequence[str]) -> list[dict]:
    """Row groups of a file from its footer alone: byte span over all columns, row count, and statistics."""
    import pyarrow.parquet as pq

    raw, _ = open_raw(path)
    with raw:
        return _footer_rows(pq.ParquetFile(raw), path, ranges)


def _footer_rows(file, path: str, ranges: Sequence[str]) -> list[dict]:
    names = file.schema_arrow.names
    out = []
    for g in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(g)
        chunks = [group.column(k) for k in range(group.num_columns)]
        begin = [min(o for o in (c.dictionary_page_offset, c.data_page_offset) if o) for c in chunks]
        row = {
            "row_group_id": g,
            "byte_offset": min(begin),
            "byte_length": max(b + c.total_compressed_size for b, c in zip(begin, chunks, strict=True)) - min(begin),
            "row_count": group.num_rows,
        }
        by_name = {c.path_in_schema: c for c in chunks}
        for c in ("timestamp_ns", "robot_id", "session_id", *ranges):
            if c not in names:
                raise ValueError(f"{path}: column {c} is missing")
            stats = by_name[c].statistics
            if stats is None or not stats.has_min_max:
                raise ValueError(f"{path}: row group {g} has no statistics of {c}")
            row[f"min_{c}"], row[f"max_{c}"] = stats.min, stats.max
        for c in ("robot_id", "session_id"):
            if row[f"min_{c}"] != row[f"max_{c}"]:
                raise ValueError(f"{path}: row group {g} mixes values of {c}")
            row[c] = row.pop(f"min_{c}")
            row.pop(f"max_{c}")
        row["start_ts_ns"], row["end_ts_ns"] = row.pop("min_timestamp_ns"), row.pop("max_timestamp_ns")
        out.append(row)
    return out


def _gap_of(times, threshold_ns: int | None) -> dict:
    """The gap columns of one row group's times, as gap_metadata has them."""
    import numpy as np

    t = np.sort(np.asarray(times, np.int64))
    d = np.diff(t)
    up = d[d > 0]
    nominal = 0
    if len(up):
        s = np.sort(up)
        m = len(s) // 2
        nominal = int(s[m]) if len(s) % 2 else int((int(s[m - 1]) + int(s[m]) + 1) // 2)
    limit = max(1, threshold_ns or 5 * nominal)
    gap = np.flatnonzero(d > limit)
    if not len(gap):
        return {"gap_count": 0, "max_gap_ns": 0, "max_gap_start_ts_ns": 0, "max_gap_end_ts_ns": 0, "nominal_dt_ns": nominal}
    k = int(gap[np.argmax(d[gap])])
    return {"gap_count": len(gap), "max_gap_ns": int(d[k]), "max_gap_start_ts_ns": int(t[k]), "max_gap_end_ts_ns": int(t[k + 1]), "nominal_dt_ns": nominal}


def index_files(spark: SparkSession, files: Sequence[str], kind: str, uri: str | None = None, threshold_ns: int | None = None) -> DataFrame:
    """Catalog of `pose`, `imu` or `camera` files. Each file is a task: it reads the footer, and of the data only the
    time column, row group by row group, for the gaps. `uri` names a single file in the catalog otherwise."""
    schema = {"pose": POSE_CATALOG_SCHEMA, "imu": IMU_CATALOG_SCHEMA, "camera": MEDIA_CATALOG_SCHEMA}[kind]
    ranges = {"pose": POSE_RANGES, "imu": IMU_RANGES, "camera": ()}[kind]
    files = list(files)

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, _ = open_raw(path)
                file = pq.ParquetFile(raw)
                rows = _footer_rows(file, path, ranges)
                for row in rows:
                    row["file_uri"] = name
                    if kind == "camera":
                        row["modality"] = "camera"
                        group = file.read_row_group(row["row_group_id"], columns=["stream_id"])
                        streams = set(group.column(0).to_pylist())
                        if len(streams) != 1:
                            raise ValueError(f"{path}: row group {row['row_group_id']} mixes streams")
                        row["stream_id"] = streams.pop()
                        row |= {f"{m}_{a}": None for m in ("min", "max") for a in "xyz"}
                    else:
                        times = file.read_row_group(row["row_group_id"], columns=["timestamp_ns"]).column(0).to_numpy()
                        row |= _gap_of(times, threshold_ns)
                names = [f.name for f in schema]
                from pyspark.sql.pandas.types import to_arrow_schema

                raw.close()
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=to_arrow_schema(schema))

    listed = spark.createDataFrame([(f, uri if uri and len(files) == 1 else f) for f in files], "path string, uri string")
    return listed.repartition(max(1, len(files))).mapInArrow(run, schema)


def with_spatial_keys(catalog: DataFrame) -> DataFrame:
    """The catalog's derived columns: box centre, tiles, hour bucket, and Hilbert keys of centre and box."""
    box = hilbert_range(F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"))
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    return catalog.withColumn("_h", box).select(
        *catalog.columns,
        cx.alias("center_x"),
        cy.alias("center_y"),
        *(tile(F.col(f"{m}_{a}")).alias(f"tile_{m}_{a}") for a in "xy" for m in ("min", "max")),
        hour_bucket(F.col("start_ts_ns")).alias("time_bucket_ns"),
        hilbert(quantize(cx), quantize(cy)).alias("hilbert_xy"),
        F.col("_h.lo").alias("hilbert_min_xy"),
        F.col("_h.hi").alias("hilbert_max_xy"),
    )


def fake_catalog(spark: SparkSession, sessions: int = 50_000, robots: int = 20) -> DataFrame:
    """Pose catalog of a made-up fleet, one row group a session, by fixed modular formulae."""
    i = F.col("id")
    r, k = i % robots, F.expr(f"id div {robots}")
    start = F.lit(1_700_000_000_000_000_000) + i * 3_600_000_000_000
    min_x = F.lit(-72.0) + ((k * 13 + r * 13) % 90) * F.lit(1.5)
    min_y = F.lit(-42.0) + ((k * 7 + r * 5) % 64).cast("double")
    cols: dict[str, Column] = {
        "robot_id": F.concat(F.lit("humanoid_"), F.lpad((r + 1).cast("string"), 2, "0")),
        "session_id": F.concat(F.lit("session_"), F.lpad(i.cast("string"), 6, "0")),
        "file_uri": F.concat(F.lit("memory://fleet/"), i.cast("string"), F.lit(".parquet")),
        "row_group_id": i % 128,
        "start_ts_ns": start,
        "end_ts_ns": start + 3_600_000_000_000,
        "min_x": min_x,
        "max_x": min_x + 1.25 + (r % 4) * F.lit(0.25),
        "min_y": min_y,
        "max_y": min_y + 1.25 + (k % 4) * F.lit(0.25),
        "min_z": F.lit(-1.0),
        "max_z": F.lit(3.0),
        "min_velocity": (i % 3) * F.lit(0.25),
        "max_velocity": F.lit(1.0) + (i % 12),
        "byte_offset": i * 65_536 + 4_096,
        "byte_length": F.lit(65_536),
        "row_count": F.lit(3_600),
        "gap_count": F.lit(0),
        "max_gap_ns": F.lit(0),
        "max_gap_start_ts_ns": F.lit(0),
        "max_gap_end_ts_ns": F.lit(0),
        "nominal_dt_ns": F.lit(1_000_000_000),
    }
    return typed(spark.range(sessions).select(*(c.alias(n) for n, c in cols.items())), POSE_CATALOG_SCHEMA)


def save(root: str, pose: DataFrame, imu: DataFrame | None = None, media: DataFrame | None = None, strategy: str = "hilbert") -> None:
    """A catalog root: three Parquet tables, pose clustered by robot, hour and Hilbert key. An empty pose catalog is an
    error; missing others are written empty."""
    spark = pose.sparkSession
    if not pose.limit(1).count():
        raise ValueError("the pose catalog is empty")
    keyed = with_spatial_keys(pose).withColumn("index_strategy", F.lit(strategy))
    keyed.repartitionByRange("robot_id", "time_bucket_ns").sortWithinPartitions("robot_id", "time_bucket_ns", "hilbert_xy").write.mode(
        "overwrite"
    ).parquet(f"{root}/pose_row_groups")
    for df, schema, name in ((imu, IMU_CATALOG_SCHEMA, "imu_row_groups"), (media, MEDIA_CATALOG_SCHEMA, "media_row_groups")):
        out = typed(df, schema) if df is not None else spark.createDataFrame([], schema)
        out.write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{root}/{k}_row_groups") for k in ("pose", "imu", "media")}
