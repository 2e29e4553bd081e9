"""Command line: python -m rowscout <group> <command> ... Exit codes: 2 for wrong usage, 1 for failure."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict



def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("rowscout").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _box(text: str) -> tuple[float, ...]:
    got = tuple(float(x) for x in text.split(","))
    if len(got) != 6:
        raise argparse.ArgumentTypeError("a bbox has six numbers")
    return got


def _ids(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def _show(body) -> None:
    print(json.dumps(body, indent=2, default=str))


def _identity(p, robot="robot_01", session="session_001", rows=100) -> None:
    p.add_argument("--robot-id", default=robot)
    p.add_argument("--session-id", default=session)
    p.add_argument("--row-group-rows", type=int, default=rows)


def _filters(p) -> None:
    p.add_argument("--robot-id")
    p.add_argument("--session-id")
    p.add_argument("--start-ts-ns", type=int)
    p.add_argument("--end-ts-ns", type=int)
    p.add_argument("--bbox", type=_box)
    p.add_argument("--min-velocity", type=float)
    p.add_argument("--predicate")


def _filter_args(a) -> dict:
    return {k: getattr(a, k) for k in ("robot_id", "session_id", "start_ts_ns", "end_ts_ns", "bbox", "min_velocity", "predicate")}


def catalog_command(a) -> None:
    from .operators import catalog
    from .plans.planner import explain
    from .sinks.tables import parquet_files

    spark = _spark()
    if a.command in ("fake", "fake-db"):
        fleet = catalog.fake_catalog(spark, a.sessions, a.robots or (max(20, a.sessions // 400) if a.command == "fake-db" else 20))
        if a.command == "fake":
            fleet.write.mode("overwrite").parquet(a.out)
        else:
            catalog.save(a.out, fleet, strategy=a.spatial_index)
        _show({"sessions": a.sessions, "out": a.out})
    elif a.command in ("build", "build-imu", "build-media"):
        kind = {"build": "pose", "build-imu": "imu", "build-media": "camera"}[a.command]
        files = [f for path in a.inputs for f in parquet_files(path)]
        got = catalog.index_files(spark, files, kind, a.uri, a.gap_threshold_ns)
        got.write.mode("overwrite").parquet(a.out)
        _show({"row_groups": spark.read.parquet(a.out).count(), "out": a.out})
    elif a.command == "db-build":
        read = lambda p: spark.read.parquet(p) if p else None
        catalog.save(a.out, read(a.pose), read(a.imu), read(a.media), a.spatial_index)
        _show({"out": a.out})
    else:
        source = {"catalog_db": a.catalog_db} if a.catalog_db else {"catalog": a.catalog}
        got = explain(**source, **_filter_args(a), spark=spark)
        if a.json:
            _show(got)
        else:
            print("\n".join(f"{k}={v}" for k, v in got.items()))


def ingest_command(a) -> None:
    from .sinks import tables
    from .sources import mcap, robots
    from .sources.synthetic import synthetic_pose

    spark = _spark()
    who = (a.robot_id, a.session_id)
    if a.command == "synthetic-mcap":
        rows = synthetic_pose(spark, a.hz, a.duration_s, a.start_ts_ns, *who).orderBy("timestamp_ns").drop("robot_id", "session_id", "velocity")
        _show({"messages": mcap.write_json_poses(a.out, (r.asDict() for r in rows.toLocalIterator()), a.topic), "out": a.out})
        return
    make = {
        "synthetic-parquet": lambda: synthetic_pose(spark, a.hz, a.duration_s, a.start_ts_ns, *who),
        "mcap-json": lambda: mcap.read_poses(spark, a.input, a.topic, *who, encodings=("json",)),
        "mcap-pose": lambda: mcap.read_poses(spark, a.input, a.topic, *who),
        "kitti-oxts": lambda: robots.kitti_oxts(spark, a.input, *who),
        "nuscenes-ego": lambda: robots.nuscenes_ego(spark, a.input, *who),
        "euroc-groundtruth": lambda: robots.euroc_groundtruth(spark, a.input, *who),
        "euroc-imu": lambda: robots.euroc_imu(spark, a.input, *who),
        "euroc-camera": lambda: robots.euroc_camera(spark, a.input, a.stream, *who),
    }[a.command]
    write = {"euroc-imu": tables.write_imu, "euroc-camera": tables.write_camera}.get(a.command, tables.write_pose)
    write(make(), a.out, a.row_group_rows)
    _show({"rows": spark.read.parquet(a.out).count(), "out": a.out})


def read_command(a) -> None:
    """index, range-read, tensor and media: the pieces that a query is made of."""
    from .operators import catalog
    from .operators.audit import Span, read_range

    spark = _spark()
    if a.group == "index":
        rows = catalog.index_files(spark, [a.input], "pose", a.uri).orderBy("row_group_id").collect()
        _show([r.asDict() for r in rows])
    elif a.group == "range-read":
        rows = catalog.footer_rows(a.input, ())[: a.limit or None]
        got = [{"row_group_id": r["row_group_id"], "offset": r["byte_offset"], "bytes": len(read_range(a.input, r["byte_offset"], r["byte_length"]))} for r in rows]
        _show({"reads": got, "bytes": sum(g["bytes"] for g in got)})
    else:
        spans = [Span(r["row_group_id"], r["byte_offset"], r["byte_length"]) for r in catalog.footer_rows(a.input, ()) if r["row_group_id"] in a.row_groups]
        if a.group == "media":
            from .sinks.media import extract_frames

            _show(extract_frames(spark, [(a.input, spans)], a.out, a.enforce_ranges, a.footer_allowance_bytes))
            return
        from pyspark.sql import functions as F

        from .operators.resample import tensorize, tensorize_imu
        from .schemas import IMU_SCHEMA, POSE_SCHEMA
        from .sinks.tables import write_npy
        from .sources.rowgroups import scan

        imu = a.command == "imu-row-groups"
        rows = scan(spark, IMU_SCHEMA if imu else POSE_SCHEMA, [(a.input, spans)], a.enforce_ranges, a.footer_allowance_bytes).where("audit is null").withColumn("window_id", F.lit(0))
        win = spark.createDataFrame([(0, a.start_ts_ns, a.end_ts_ns)], "window_id int, start_ts_ns long, end_ts_ns long")
        pdf = (tensorize_imu if imu else tensorize)(rows, win, ["window_id"], a.target_hz).orderBy("k").toPandas()
        names = write_npy(a.out, pdf.drop(columns=["window_id", "k", "ts_ns"]).to_numpy(), pdf["ts_ns"].to_numpy())
        _show({"shape": [len(pdf), pdf.shape[1] - 3], "files": names})


def store_command(a) -> None:
    from .sources import store

    spark = _spark()
    if a.command == "list":
        _show([asdict(o) for o in store.list_objects(spark, a.uri, a.limit)])
    elif a.command == "put":
        _show({"bytes": store.put_object(spark, a.local, a.uri)})
    elif a.command == "get":
        _show({"bytes": store.get_object(spark, a.uri, a.local)})
    else:
        _show({"files": store.sync_prefix(spark, a.uri, a.local, a.limit)})


def query_command(a) -> None:
    from .plans.query import query, query_batch

    spark = _spark()
    source = {"catalog_db": a.catalog_db} if a.catalog_db else {"catalog": a.catalog, "imu_catalog": a.imu_catalog, "media_catalog": a.media_catalog}
    run = query_batch if a.batch else query
    got = run(
        **source, **_filter_args(a), channels=tuple(a.channels.split(",")), target_hz=a.target_hz, gap_policy=a.gap_policy, max_egress_bytes=a.max_egress_bytes,
        enforce_ranges=a.enforce_ranges, manifest_out=a.manifest_out, materialize_media=bool(a.media_out), media_out=a.media_out, spark=spark,
    )
    print("\n".join(got.diagnostics.log_lines()))
    print(f"shape={list(got.certificate.shape)}")


def dataset_command(a) -> None:
    from .onboarding import adapters as ad
    from .plans.query import query_managed_dataset
    from .sources import store

    if a.command == "adapters":
        _show(ad.list_adapters())
        return
    spark = _spark()
    if a.command == "inspect":
        body = ad.inspect_dataset(a.input, a.adapter, spark).to_dict()
        if a.out:
            ad.write_json(a.out, body)
        _show(body)
    elif a.command in ("init-manifest", "init-mapping"):
        profile = ad.inspect_dataset(a.input, "generic_dataset" if a.command == "init-mapping" else a.adapter, spark)
        body = ad.suggest_manifest(profile, dataset_id=a.dataset_id, robot_id=a.robot_id, session_id=a.session_id)
        ad.write_json(a.out, body)
        _show(body)
    elif a.command == "validate":
        report = ad.validate_manifest(a.input)
        _show(report.to_dict())
        if not report.valid:
            raise SystemExit(1)
    elif a.command == "ingest":
        _show(ad.ingest_manifest(a.input, output_root=a.out, row_group_rows=a.row_group_rows, spark=spark).to_dict())
    elif a.command == "query":
        got = query_managed_dataset(a.input, **_filter_args(a), channels=tuple(a.channels.split(",")), target_hz=a.target_hz, manifest_out=a.out, spark=spark)
        _show({"shape": list(got.certificate.shape), "row_groups": got.row_groups, "selected_bytes": got.selected_bytes})
    elif a.command == "demo":
        from .onboarding import demo

        _show(demo.run(a.out, spark))
    elif a.command == "stage":
        _show(store.stage_prefix(spark, a.input, a.out))
    else:
        _show(store.upload_folder(spark, a.input, a.out))


def validate_command(a) -> None:
    """Reads the chosen row groups of a file in a store, under enforcement, and says what was read."""
    import json as js

    from .operators import catalog
    from .operators.audit import Span
    from .schemas import POSE_SCHEMA
    from .sources.rowgroups import scan

    spark = _spark()
    footers = catalog.footer_rows(a.input, ())
    spans = [Span(r["row_group_id"], r["byte_offset"], r["byte_length"]) for r in footers if not a.row_groups or r["row_group_id"] in a.row_groups]
    rows = scan(spark, POSE_SCHEMA, [(a.input, spans)], True, a.footer_allowance_bytes).cache()
    report = js.loads(rows.where("audit is not null").first()["audit"])["report"]
    _show({"rows": rows.where("audit is null").count(), **report})


def gate_command(a) -> None:
    from .plans.proof import choose_query, gate

    spark = _spark()
    source = {"catalog_db": a.catalog_db} if a.catalog_db else {"catalog": a.catalog}
    options = source | _filter_args(a) | {"seam_check": False, "gap_policy": "allow"}
    if a.choose:
        pose = spark.read.parquet(f"{a.catalog_db}/pose_row_groups" if a.catalog_db else a.catalog)
        options |= choose_query(pose)
    got = gate(options, iterations=a.iterations, max_p95_ms=a.max_p95_ms, min_prune_ratio=a.min_prune_ratio, max_authorized_bytes=a.max_authorized_bytes, spark=spark)
    _show(asdict(got))
    if not got.ok:
        raise SystemExit(1)


def demo_command(a) -> None:
    """Synthetic session to tensor: 50 Hz, 25 rows a row group, the box and speed of the first one."""
    import tempfile

    from .operators import catalog
    from .plans.query import query
    from .sinks.tables import parquet_files, write_pose
    from .sources.synthetic import synthetic_pose

    spark = _spark()
    root = a.out or tempfile.mkdtemp(prefix="rowscout-demo-")
    write_pose(synthetic_pose(spark, hz=50, duration_s=1.0), f"{root}/pose", 25)
    cat = catalog.index_files(spark, parquet_files(f"{root}/pose"), "pose")
    got = query(catalog=cat, bbox=(-0.1, 2, -1.1, 1.1, -0.1, 0.1), min_velocity=2, end_ts_ns=480_000_000, target_hz=30, enforce_ranges=True, spark=spark)
    print("\n".join(got.diagnostics.log_lines()))
    print(f"shape={list(got.tensor.shape)}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rowscout", description=__doc__)
    # fixed values: the names of groups, commands and options are public
    groups = top.add_subparsers(dest="group", required=True)

    def group(name, run):
        g = groups.add_parser(name)
        g.set_defaults(run=run)
        return g.add_subparsers(dest="command", required=True)

    cat = group("catalog", catalog_command)
    for name in ("fake", "fake-db"):
        p = cat.add_parser(name)
        p.add_argument("--out", required=True)
        p.add_argument("--sessions", type=int, default=50_000)
        p.add_argument("--robots", type=int)
        p.add_argument("--spatial-index", choices=("hilbert", "tile"), default="hilbert")
    for name in ("build", "build-imu", "build-media"):
        p = cat.add_parser(name)
        p.add_argument("inputs", nargs="+")
        p.add_argument("--out", required=True)
        p.add_argument("--uri")
        p.add_argument("--gap-threshold-ns", type=int)
    p = cat.add_parser("db-build")
    p.add_argument("--pose", required=True)
    p.add_argument("--imu")
    p.add_argument("--media")
    p.add_argument("--out", required=True)
    p.add_argument("--spatial-index", choices=("hilbert", "tile"), default="hilbert")
    p = cat.add_parser("explain")
    p.add_argument("--catalog")
    p.add_argument("--catalog-db")
    p.add_argument("--json", action="store_true")
    _filters(p)

    ing = group("ingest", ingest_command)
    for name, rows, robot in (
        ("synthetic-parquet", 100, "robot_01"), ("synthetic-mcap", 100, "robot_01"), ("mcap-json", 100, "robot_01"), ("mcap-pose", 100, "robot_01"),
        ("kitti-oxts", 100, "kitti_vehicle"), ("nuscenes-ego", 100, "nuscenes_ego"), ("euroc-groundtruth", 500, "euroc_mav"), ("euroc-imu", 2000, "euroc_mav"), ("euroc-camera", 20, "euroc_mav"),
    ):
        p = ing.add_parser(name)
        if not name.startswith("synthetic"):
            p.add_argument("input")
        p.add_argument("--out", required=True)
        p.add_argument("--topic", default="/pose")
        p.add_argument("--stream", default="cam0")
        p.add_argument("--hz", type=float, default=100.0)
        p.add_argument("--duration-s", type=float, default=1.0)
        p.add_argument("--start-ts-ns", type=int, default=0)
        _identity(p, robot, rows=rows)

    for name, commands in (("index", ("parquet",)), ("range-read", ("parquet",)), ("tensor", ("row-groups", "imu-row-groups")), ("media", ("camera-row-groups",))):
        g = group(name, read_command)
        for c in commands:
            p = g.add_parser(c)
            p.add_argument("input")
            p.add_argument("--uri")
            p.add_argument("--limit", type=int, default=0)
            p.add_argument("--row-groups", type=_ids, default=[])
            p.add_argument("--out", default="out")
            p.add_argument("--start-ts-ns", type=int, default=0)
            p.add_argument("--end-ts-ns", type=int, default=0)
            p.add_argument("--target-hz", type=float, default=30.0)
            p.add_argument("--enforce-ranges", action="store_true")
            p.add_argument("--footer-allowance-bytes", type=int, default=16 << 20)

    st = group("object-store", store_command)
    for c in ("put", "get", "list", "sync-prefix"):
        p = st.add_parser(c)
        p.add_argument("uri")
        p.add_argument("--local", default=".")
        p.add_argument("--limit", type=int, default=0)

    q = groups.add_parser("query")
    q.set_defaults(run=query_command)
    for name in ("catalog", "catalog-db", "imu-catalog", "media-catalog", "manifest-out", "media-out"):
        q.add_argument(f"--{name}")
    q.add_argument("--channels", default="pos_xyz,rot_wxyz,vel_xyz")
    q.add_argument("--target-hz", type=float, default=30.0)
    q.add_argument("--gap-policy", choices=("reject", "allow"), default="reject")
    q.add_argument("--max-egress-bytes", type=int, default=1_000_000_000)
    q.add_argument("--enforce-ranges", action="store_true")
    q.add_argument("--batch", action="store_true")
    _filters(q)

    d = group("dataset", dataset_command)
    for c in ("adapters", "inspect", "init-manifest", "init-mapping", "validate", "ingest", "query", "stage", "upload", "demo"):
        p = d.add_parser(c)
        if c not in ("adapters", "demo"):
            p.add_argument("input")
        p.add_argument("--out", required=c in ("init-manifest", "init-mapping", "ingest", "stage", "upload", "demo"))
        p.add_argument("--adapter", default="auto")
        if c == "query":
            p.add_argument("--channels", default="pos_xyz,rot_wxyz,vel_xyz")
            p.add_argument("--target-hz", type=float, default=30.0)
            _filters(p)
        else:
            p.add_argument("--dataset-id", default="dataset")
            _identity(p, rows=500)

    v = group("validate", validate_command)
    p = v.add_parser("parquet")
    p.add_argument("input")
    p.add_argument("--row-groups", type=_ids, default=[])
    p.add_argument("--footer-allowance-bytes", type=int, default=16 << 20)

    g = groups.add_parser("gate")
    g.set_defaults(run=gate_command)
    g.add_argument("--catalog")
    g.add_argument("--catalog-db")
    g.add_argument("--choose", action="store_true")
    g.add_argument("--iterations", type=int, default=20)
    g.add_argument("--max-p95-ms", type=float, default=float("inf"))
    g.add_argument("--min-prune-ratio", type=float, default=0.0)
    g.add_argument("--max-authorized-bytes", type=float, default=float("inf"))
    _filters(g)

    demo = groups.add_parser("demo")
    demo.set_defaults(run=demo_command)
    demo.add_argument("--out")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a)
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
