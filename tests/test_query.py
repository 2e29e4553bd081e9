"""Goldens of planning and querying on tiny sessions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowscout.operators import catalog
from rowscout.operators.audit import RangeViolationError
from rowscout.plans.planner import explain, plan, plan_batch
from rowscout.plans.query import query, query_batch, query_managed_dataset
from rowscout.plans.report import EgressLimitError, ExtrapolationError, TemporalGapError
from rowscout.schemas import CAMERA_SCHEMA, IMU_SCHEMA, POSE_SCHEMA
from rowscout.sinks.tables import parquet_files, write_camera, write_imu, write_pose
from rowscout.sources.synthetic import synthetic_pose

MS = 1_000_000


def pose_rows(spark, rows, session="session_a"):
    """rows: (ts, x, vx)."""
    full = [(ts, "robot_01", session, float(x), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, float(v), 0.0, 0.0, abs(float(v))) for ts, x, v in rows]
    return spark.createDataFrame(full, POSE_SCHEMA)


def mini(spark, root, session="session_a", start=1_000_000_000, prefix="fake"):
    """A small session with poses, inertial samples and two frames."""
    base = start - 1_000_000_000
    pose = pose_rows(spark, [(base + 1000 * MS, 0, 2), (base + 1500 * MS, 1, 2), (base + 2000 * MS, 2, 2)], session)
    imu = [(900, 0.1, 0.2, 0.3, 9, 0, -1), (1250, 0.2, 0.3, 0.4, 10, 1, -2), (1750, 0.4, 0.5, 0.6, 12, 3, -4), (2100, 0.5, 0.6, 0.7, 13, 4, -5)]
    imu = spark.createDataFrame([(base + t * MS, "robot_01", session, float(ax), float(ay), float(az), gx, gy, gz) for t, gx, gy, gz, ax, ay, az in imu], IMU_SCHEMA)
    frames = [(base + t * MS, "robot_01", session, "cam0", f"data/{t}.png", f"{prefix}-camera-frame-{i}".encode()) for i, t in ((1, 1000), (2, 1500))]
    camera = spark.createDataFrame(frames, CAMERA_SCHEMA)
    out = {}
    for kind, df, write, rows in (("pose", pose, write_pose, 2), ("imu", imu, write_imu, 2), ("camera", camera, write_camera, 1)):
        path = f"{root}/{session}/{kind}"
        write(df, path, rows)
        out[kind] = catalog.index_files(spark, parquet_files(path), kind)
    return out


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    write_pose(synthetic_pose(spark, hz=50, duration_s=1.0), f"{root}/pose", 25)
    files = parquet_files(f"{root}/pose")
    return catalog.index_files(spark, files, "pose").cache()


def test_row_groups_of_the_demo(demo):
    rows = demo.orderBy("row_group_id").collect()
    assert [(r.row_count, r.start_ts_ns, r.end_ts_ns) for r in rows] == [(25, 0, 480 * MS), (25, 500 * MS, 980 * MS), (1, 1000 * MS, 1000 * MS)]
    assert all(r.byte_length > 0 and r.gap_count == 0 for r in rows)


@pytest.mark.parametrize("channels,width", [(("pos_xyz", "rot_wxyz"), 7), (("pos_xyz", "rot_wxyz", "vel_xyz"), 10)])
def test_demo_query(spark, demo, channels, width):
    got = query(catalog=demo, start_ts_ns=0, end_ts_ns=480 * MS, min_velocity=2, channels=channels, target_hz=30, spark=spark)
    assert got.tensor.shape == (15, width) and got.row_groups == (0,)
    assert np.allclose(got.tensor[:, 0], 2 * got.timestamps_ns / 1e9)
    assert got.certificate.shape == (15, width) and not got.certificate.validity_warnings


def test_enforced_reads_are_audited(spark, demo):
    got = query(catalog=demo, end_ts_ns=480 * MS, enforce_ranges=True, spark=spark)
    d = got.diagnostics
    assert d.range_audit_passed and d.range_violations == 0 and d.actual_cold_reads > 0
    assert d.actual_authorized_bytes > 0 and d.footer_bytes > 0
    assert {r["category"] for r in got.manifest["actual_reads"]} == {"authorized", "footer"}


def test_too_small_footer_allowance_fails_closed(spark, demo):
    with pytest.raises(RangeViolationError):
        query(catalog=demo, end_ts_ns=480 * MS, enforce_ranges=True, footer_allowance_bytes=4, spark=spark)


def test_mini_session_tensor(spark, tmp_path):
    cats = mini(spark, tmp_path)
    got = query(
        catalog=cats["pose"], imu_catalog=cats["imu"], media_catalog=cats["camera"], predicate="velocity_magnitude >= 1.5",
        start_ts_ns=1_000_000_000, end_ts_ns=2_000_000_000, channels=("pos_xyz", "imu_accel", "imu_gyro", "camera:cam0"), target_hz=2,
        materialize_media=True, media_out=str(tmp_path / "frames"), manifest_out=str(tmp_path / "m.json"), spark=spark,
    )
    assert got.tensor.shape == (3, 9)
    assert np.allclose(got.tensor[1], [1, 0, 0, 11, 2, -3, 0.3, 0.4, 0.5])
    assert [f["bytes"] for f in got.media_manifest["frames"]] == [19, 19]
    assert open(tmp_path / "frames/cam0/1000000000.png", "rb").read() == b"fake-camera-frame-1"
    assert json.load(open(tmp_path / "m.json"))["tensor_certificate"]["shape"] == [3, 9]
    assert len(got.diagnostics.log_lines()) == 53


def test_gap_is_rejected_unless_allowed(spark, tmp_path):
    write_pose(pose_rows(spark, [(0, 0, 1), (100 * MS, 0.1, 1), (200 * MS, 0.2, 1), (1000 * MS, 1, 1)]), f"{tmp_path}/p", 100)
    cat = catalog.index_files(spark, parquet_files(f"{tmp_path}/p"), "pose")
    with pytest.raises(TemporalGapError):
        plan(catalog=cat, spark=spark)
    got = query(catalog=cat, channels=("pos_xyz",), target_hz=2, gap_policy="allow", spark=spark)
    d = got.diagnostics
    assert got.tensor.shape == (3, 3)
    assert (d.pose_gap_count, d.pose_max_gap_ns, d.pose_max_gap_start_ts_ns, d.pose_max_gap_end_ts_ns) == (1, 800 * MS, 200 * MS, 1000 * MS)


def test_gap_between_row_groups_is_seen(spark, tmp_path):
    write_pose(pose_rows(spark, [(t * MS, 0, 1) for t in (0, 10, 20, 30, 500, 510, 520, 530)]), f"{tmp_path}/p", 4)
    cat = catalog.index_files(spark, parquet_files(f"{tmp_path}/p"), "pose")
    with pytest.raises(TemporalGapError):
        plan(catalog=cat, spark=spark)
    assert plan(catalog=cat, seam_check=False, spark=spark).row_groups == (0, 1)


def test_batch_keeps_sessions_apart(spark, tmp_path):
    a, b = mini(spark, tmp_path, "session_a", 1_000_000_000, "a"), mini(spark, tmp_path, "session_b", 4_000_000_000, "b")
    both = {k: a[k].unionByName(b[k]) for k in a}
    with pytest.raises(ValueError, match="query_batch"):
        plan(catalog=both["pose"], spark=spark)
    options = dict(catalog=both["pose"], imu_catalog=both["imu"], media_catalog=both["camera"], channels=("pos_xyz", "imu_accel", "camera:cam0"), spark=spark)
    p = plan_batch(**options)
    assert [w.session_id for w in p.windows] == ["session_a", "session_b"]
    assert [sum(len(getattr(w, f"{k}_row_groups")) for w in p.windows) for k in ("pose", "imu", "media")] == [4, 4, 4]
    got = query_batch(target_hz=2, materialize_media=True, media_out=str(tmp_path / "out"), enforce_ranges=True, **options)
    assert [w.tensor.shape for w in got.windows] == [(3, 6), (3, 6)]
    assert (tmp_path / "out/window_000_session_a/cam0/1000000000.png").read_bytes() == b"a-camera-frame-1"
    assert (tmp_path / "out/window_001_session_b/cam0/4000000000.png").exists()
    assert got.certificate.shape == (6, 6) and got.diagnostics.range_violations == 0
    alone = [query(target_hz=2, materialize_media=True, media_out=str(tmp_path / "one"), enforce_ranges=True, channels=options["channels"], spark=spark,
                   catalog=s["pose"], imu_catalog=s["imu"], media_catalog=s["camera"]) for s in (a, b)]
    told = ("actual_cold_reads", "actual_cold_read_bytes", "actual_authorized_bytes", "footer_bytes")
    for k in told:
        each = [getattr(r.diagnostics, k) for r in alone]
        assert [getattr(w.diagnostics, k) for w in got.windows] == each == [w.manifest[k] for w in got.windows] and min(each) > 0
        assert getattr(got.diagnostics, k) == sum(each) == got.manifest["diagnostics"][k]
    assert got.certificate.cold_read_bytes == sum(r.certificate.cold_read_bytes for r in alone)


def test_shared_row_groups_count_once():
    """Two windows of one file: each report has all its reads, the batch has every read once."""
    from rowscout.plans.query import _Reader
    from rowscout.plans.report import CorrectnessReport, RowGroupSpan, SeekPlan, combined

    span = lambda g: RowGroupSpan("pose", "f", g, 0, 1, 100 * g, 100)
    windows = [SeekPlan(0, 1, "f", tuple(map(span, groups)), (), (), 0, 0, 0, 0, 0, 0, False, 0, CorrectnessReport()) for groups in ((0, 1), (1, 2))]
    reader = _Reader(None, True, 0)
    reader.records["f"] = [{"offset": o, "length": n, "category": c} for o, n, c in ((900, 10, "footer"), (0, 50, "authorized"), (100, 60, "authorized"), (200, 70, "authorized"))]
    totals = [reader.totals_of(w) for w in windows]
    assert [(t.reads, t.bytes, t.footer_bytes, t.max_end) for t in totals] == [(3, 120, 10, 910), (3, 140, 10, 910)]
    whole = combined([CorrectnessReport(**t.fields()) for t in totals], reader.totals())
    assert (whole.actual_cold_reads, whole.actual_cold_read_bytes, whole.footer_bytes, whole.max_footer_read_end) == (4, 190, 10, 910)


QUERIES = {
    "tight": {"bbox": (-60, -58, -30, -28, -2, 4)},
    "broad and fast": {"bbox": (-72, 0, -42, 0, -2, 4), "min_velocity": 6.0},
    "times": {"start_ts_ns": 1_700_000_000_000_000_000, "end_ts_ns": 1_700_400_000_000_000_000},
    "predicate": {"predicate": "velocity_magnitude > 8 AND ST_Intersects(position, bbox(-70,-10,-40,20,-2,4)) AND time_overlap(1700010800000000000,1703914400000000000)"},
    "all robots": {"robot_id": None, "min_velocity": 11.5},
    "one session": {"robot_id": None, "session_id": "session_000123"},
    "nobody": {"robot_id": "nobody"},
    "limit": {"limit": 3},
}


@pytest.mark.parametrize("strategy", ["hilbert", "tile"])
def test_plans_from_memory_equal_sparks(spark, tmp_path, strategy):
    from dataclasses import asdict

    from rowscout.operators.catalog import fake_catalog, save
    from rowscout.plans import planner

    pose = fake_catalog(spark, 2000, 5)
    save(str(tmp_path / "c"), pose, strategy=strategy)
    for options in QUERIES.values():
        options = {"robot_id": "humanoid_04", "seam_check": False, "max_egress_bytes": 1 << 60, "spark": spark} | options
        told = []
        for held in (True, False):
            planner._KNOWN.clear()
            if not held:  # the same catalog, but without a table in memory
                planner.Catalogs.of(spark, None, str(tmp_path / "c"), None, None).hot.clear()
            try:
                p = plan_batch(catalog_db=str(tmp_path / "c"), **options)
                told.append([asdict(w) for w in p.windows] + [asdict(p.diagnostics)])
            except LookupError as e:
                told.append(str(e))
            assert bool(planner.Catalogs.of(spark, None, str(tmp_path / "c"), None, None).hot) == held
        for found in told:
            for w in found if isinstance(found, list) else ():
                (w.get("diagnostics") or w)["catalog_query_ms"] = 0
        assert told[0] == told[1]


def test_many_candidates_stay_with_spark(spark, monkeypatch):
    from rowscout.operators.catalog import fake_catalog
    from rowscout.plans import planner

    options = {"catalog": fake_catalog(spark, 300, 3), "robot_id": "humanoid_02", "min_velocity": 4.0, "seam_check": False, "max_egress_bytes": 1000, "spark": spark}
    few = plan_batch(**options)
    monkeypatch.setattr(planner, "FEW_CANDIDATES", 20)
    many = plan_batch(**options)
    assert [w.pose_row_groups for w in few.windows] == [w.pose_row_groups for w in many.windows] and few.blocked_by_egress and many.blocked_by_egress
    for k in ("candidate_row_groups", "matched_row_groups", "velocity_pruned_row_groups", "time_pruned_row_groups"):
        assert getattr(few.diagnostics, k) == getattr(many.diagnostics, k)
    monkeypatch.setattr(planner, "MOST_PLANNED", 10)
    with pytest.raises(EgressLimitError, match="row groups"):
        plan_batch(**options)


def test_held_catalogs_follow_their_files(spark, tmp_path):
    from rowscout.operators.catalog import fake_catalog, save
    from rowscout.plans import hot, planner

    root = str(tmp_path / "c")
    options = {"catalog_db": root, "seam_check": False, "max_egress_bytes": 1 << 60, "spark": spark}
    save(root, fake_catalog(spark, 100, 4))
    assert plan_batch(**options).diagnostics.candidate_row_groups == 100
    first = planner.Catalogs.of(spark, None, root, None, None)
    assert planner.Catalogs.of(spark, None, root, None, None) is first and set(first.hot) == {"pose", "imu", "media"}
    save(root, fake_catalog(spark, 120, 4))
    assert plan_batch(**options).diagnostics.candidate_row_groups == 120
    assert hot.read(fake_catalog(spark, 10, 2)) is not None
    most, hot.MOST_ROWS = hot.MOST_ROWS, 5
    try:
        assert hot.read(fake_catalog(spark, 10, 2)) is None  # larger catalogs stay with Spark
    finally:
        hot.MOST_ROWS = most


def test_errors(spark, demo, tmp_path):
    with pytest.raises(EgressLimitError):
        query(catalog=demo, max_egress_bytes=10, spark=spark)
    assert plan(catalog=demo, max_egress_bytes=10, spark=spark).blocked_by_egress
    for bad in (
        dict(catalog=demo, predicate="ST_Within(position, 1)"), dict(catalog=demo, gap_policy="maybe"), dict(), dict(catalog=demo, catalog_db="x"),
        dict(catalog=demo, channels=("imu_accel",)), dict(catalog=demo, channels=("camera:x",)), dict(catalog=demo, channels=("nothing",)),
        dict(catalog=demo, bbox=(1, 2, 3)), dict(catalog=demo, output="list"),
    ):
        with pytest.raises(ValueError):
            query(spark=spark, **bad)
    with pytest.raises(LookupError):
        plan(catalog=demo, start_ts_ns=10**15, spark=spark)
    with pytest.raises(RuntimeError, match="torch"):
        query(catalog=demo, output="torch", spark=spark)
    with pytest.raises(FileNotFoundError):
        query_managed_dataset(str(tmp_path / "none"), spark=spark)


def test_extrapolation_is_refused(spark, tmp_path):
    write_pose(pose_rows(spark, [(0, 0, 1), (100 * MS, 1, 1)]), f"{tmp_path}/p", 10)
    cat = catalog.index_files(spark, parquet_files(f"{tmp_path}/p"), "pose").withColumn("end_ts_ns", F.lit(200 * MS).cast("long"))
    with pytest.raises(ExtrapolationError):
        query(catalog=cat, target_hz=20, spark=spark)


def test_fleet_catalog(spark, tmp_path):
    fleet = catalog.fake_catalog(spark, 128)
    catalog.save(str(tmp_path / "db"), fleet)
    box = (-55, -45, -30, -20, -2, 4)
    got = explain(catalog_db=str(tmp_path / "db"), bbox=box, spark=spark)
    assert got["index_strategy"] == "hilbert" and got["candidates"] == 128 and got["spatial_pruned"] > 0
    flat = explain(catalog=fleet, bbox=box, spark=spark)
    assert flat["after_exact"] == got["after_exact"] and flat["coarse_pruned"] == 0
    assert sum(r.byte_length for r in catalog.fake_catalog(spark, 3).collect()) == 3 * 65536


def test_dataframe_output_and_limit(spark, demo):
    got = query(catalog=demo, limit=2, output="dataframe", target_hz=10, spark=spark)
    assert got.row_groups == (0, 1) and got.tensor.count() == 10
    assert got.diagnostics.candidate_row_groups == 3
