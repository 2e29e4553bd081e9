"""Dataset readers, decoders and onboarding on literal fixtures."""

import json
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowscout.onboarding import mapping
from rowscout.onboarding.adapters import (
    DatasetAdapter,
    get_adapter,
    ingest_manifest,
    inspect_dataset,
    list_adapters,
    register_adapter,
    suggest_manifest,
    validate_manifest,
)
from rowscout.onboarding.records import DatasetProfile
from rowscout.plans.query import query_managed_dataset
from rowscout.sinks.tables import atomic_folder, parquet_files, read_npy_timestamps, write_npy, write_pose
from rowscout.sources import generic, mcap, robots, store
from rowscout.sources.synthetic import synthetic_pose

POSE_HEAD = "#timestamp,p_x,p_y,p_z,q_w,q_x,q_y,q_z,v_x,v_y,v_z,bgx,bgy,bgz,bax,bay,baz\n"
TIMES = (1403715274302142976, 1403715274307142912)


@pytest.fixture
def euroc(tmp_path):
    root = tmp_path / "euroc"
    for sub in ("state_groundtruth_estimate0", "imu0", "cam0/data"):
        (root / "mav0" / sub).mkdir(parents=True)
    rows = "".join(f"{t},{i}.5,2,3,1,0,0,0,0.1,0.2,0.3,0,0,0,0,0,0\n" for i, t in enumerate(TIMES))
    (root / "mav0/state_groundtruth_estimate0/data.csv").write_text(POSE_HEAD + rows)
    imu = "".join(f"{t - 10**9},0.1,0.2,0.3,9,0,-1\n" for t in (*TIMES, TIMES[1] + 2 * 10**9))
    (root / "mav0/imu0/data.csv").write_text("#timestamp,w_x,w_y,w_z,a_x,a_y,a_z\n" + imu)
    (root / "mav0/cam0/data.csv").write_text("#timestamp [ns],filename\n" + f"{TIMES[0]},{TIMES[0]}.png\n")
    (root / f"mav0/cam0/data/{TIMES[0]}.png").write_bytes(b"frame")
    (root / "mav0/cam0/sensor.yaml").write_text(
        "sensor_type: camera\nT_BS:\n  cols: 4\n  rows: 4\n  data: [1,0,0,0,\n   0,1,0,0, 0,0,1,0, 0,0,0,1]\nrate_hz: 20\nresolution: [752, 480]\nintrinsics: [458.6, 457.3, 367.2, 248.4]\n"
    )
    return str(root)


def zipped(folder, path):
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(folder):
            for n in names:
                z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), folder))
    return str(path)


@pytest.mark.parametrize("as_zip", [False, True])
def test_euroc(spark, euroc, tmp_path, as_zip):
    path = zipped(euroc, tmp_path / "e.zip") if as_zip else euroc
    poses = robots.euroc_groundtruth(spark, path).orderBy("timestamp_ns").collect()
    assert [p.timestamp_ns for p in poses] == list(TIMES) and poses[1].x == 1.5
    imu = robots.euroc_imu(spark, path).orderBy("timestamp_ns").first()
    assert (imu.ax, imu.ay, imu.az, imu.gx) == (9, 0, -1, 0.1)
    (frame,) = robots.euroc_camera(spark, path).collect()
    assert bytes(frame.camera_bytes) == b"frame" and frame.frame_path == f"mav0/cam0/data/{TIMES[0]}.png"


def test_kitti(spark, tmp_path):
    root = tmp_path / "kitti"
    (root / "oxts/data").mkdir(parents=True)
    for i, (lat, lon, alt, vn, ve, vu) in enumerate(((49.0, 8.0, 100, 1, 2, 3), (49.000001, 8.000001, 101, 1.5, 2.5, 3.5))):
        f = [lat, lon, alt, 0.1, 0.2, 0.3, vn, ve, 0, 0, vu] + [0] * 19
        (root / f"oxts/data/{i:010}.txt").write_text(" ".join(map(str, f)))
    stamps = root / "oxts/timestamps.txt"
    stamps.write_text("2011-09-26 13:02:25.000000000\n2011-09-26 13:02:25.100000000\n")
    a, b = robots.kitti_oxts(spark, str(root)).orderBy("timestamp_ns").collect()
    assert (a.x, a.y, a.z) == (0, 0, 0) and (a.vx, a.vy, a.vz) == (2, 1, 3)
    assert b.x > 0 and b.y > 0 and b.z == 1 and b.timestamp_ns - a.timestamp_ns == 10**8
    assert a.timestamp_ns == 1317042145 * 10**9
    stamps.write_text("2011-09-26 13:02:25.0\n")
    with pytest.raises(ValueError):
        robots.kitti_oxts(spark, str(root))


def test_nuscenes(spark, tmp_path):
    (tmp_path / "v1.0-mini").mkdir()
    rows = [{"timestamp": t, "translation": [x, 0, 0], "rotation": [1, 0, 0, 0]} for t, x in ((1000000, 0), (2000000, 2))]
    (tmp_path / "v1.0-mini/ego_pose.json").write_text(json.dumps(rows))
    got = robots.nuscenes_ego(spark, str(tmp_path)).orderBy("timestamp_ns").collect()
    assert [(r.timestamp_ns, r.vx) for r in got] == [(10**9, 2.0), (2 * 10**9, 2.0)]


def ros1(sec, nsec, pose):
    return struct.pack("<III", 7, sec, nsec) + struct.pack("<I", 3) + b"map" + struct.pack("<7d", *pose)


def cdr(sec, nsec, pose):
    body = struct.pack("<iI", sec, nsec) + struct.pack("<I", 4) + b"map\0"
    return b"\0\1\0\0" + body + bytes(-len(body) % 8) + struct.pack("<7d", *pose)


@pytest.mark.parametrize("chunked", [True, False])
def test_mcap(spark, tmp_path, chunked):
    path = str(tmp_path / "a.mcap")
    pose = (1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)
    flat = {"x": 5, "y": 6, "z": 7, "qw": 1, "qx": 0, "qy": 0, "qz": 0}
    odometry = {
        "header": {"stamp": {"sec": 9, "nanosec": 5}},
        "pose": {"pose": {"position": {"x": 1, "y": 1, "z": 1}, "orientation": {"x": 0, "y": 0, "z": 0, "w": 1}}},
        "twist": {"twist": {"linear": {"x": 3, "y": 4, "z": 0}}},
    }
    sent = [
        ("/pose", "json", "rowscout.pose.JsonPose", 123, json.dumps(flat).encode()),
        ("/pose", "ros1", "geometry_msgs/PoseStamped", 1, ros1(2, 3, pose)),
        ("/pose", "cdr", "geometry_msgs/msg/PoseStamped", 1, cdr(4, 6, pose)),
        ("/pose", "protobuf", "x", 1, b"?"),
        ("/other", "json", "x", 1, b"{}"),
    ]
    assert mcap.write_mcap(path, sent, chunked) == 5
    rows = mcap.read_poses(spark, path).orderBy("timestamp_ns").collect()
    assert [r.timestamp_ns for r in rows] == [123, 2 * 10**9 + 3, 4 * 10**9 + 6]
    assert rows[0].x == 5 and (rows[1].x, rows[1].qw, rows[2].z) == (1, 1, 3)
    assert rows[1].vx != 0  # derived
    mcap.write_mcap(path, [*sent, ("/pose", "json", "nav_msgs/Odometry", 1, json.dumps(odometry).encode())], chunked)
    rows = mcap.read_poses(spark, path).orderBy("timestamp_ns").collect()
    assert (rows[-1].timestamp_ns, rows[-1].velocity, rows[0].velocity) == (9 * 10**9 + 5, 5.0, 0.0)


def test_cdr_of_other_writers():
    """Bytes put down by hand: numbers are aligned after the header of four bytes, so 17 bytes of stamp and name are
    filled up to 24."""
    head = bytes.fromhex("00010000" "05000000" "07000000" "05000000") + b"odom\0" + bytes(7)
    numbers = bytes.fromhex("000000000000f03f" "0000000000000040" "0000000000000840" + "0000000000000000" * 3 + "000000000000f03f")
    assert len(head) == 4 + 24
    assert mcap.decode_cdr("geometry_msgs/msg/PoseStamped", head + numbers) == (5 * 10**9 + 7, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, None, None, None)
    with pytest.raises(ValueError, match="little-endian"):
        mcap.decode_cdr("x", b"\0\0\0\0")


def test_mcap_without_a_number_fails(spark, tmp_path):
    path = str(tmp_path / "b.mcap")
    mcap.write_mcap(path, [("/pose", "json", "s", 1, b'{"x": 1}')])
    with pytest.raises(Exception, match="JSON pose without"):
        mcap.read_poses(spark, path).collect()


def test_generic_velocity_and_time_scale(spark, tmp_path):
    (tmp_path / "p.csv").write_text("time,p_x,p_y,p_z,q_w,q_x,q_y,q_z\n0,0,0,0,1,0,0,0\n0.1,1,0,0,1,0,0,0\n0.2,3,0,0,1,0,0,0\n")
    mapping = {"timestamp": "time", "x": "p_x", "y": "p_y", "z": "p_z", "qw": "q_w", "qx": "q_x", "qy": "q_y", "qz": "q_z"}
    rows = generic.pose_table(generic.relation(spark, str(tmp_path / "p.csv")), mapping, 1e9, "r", "s").orderBy("timestamp_ns").collect()
    assert [r.timestamp_ns for r in rows] == [0, 10**8, 2 * 10**8]
    assert np.allclose([r.vx for r in rows], [10, 10, 20])
    df = spark.createDataFrame([(t, *[1.0] * 6) for t in (1000, 1001)], "t_ms long, ax double, ay double, az double, gx double, gy double, gz double")
    imu = generic.imu_table(df, {"timestamp": "t_ms", **{c: c for c in ("ax", "ay", "az", "gx", "gy", "gz")}}, 1e6, "r", "s")
    assert sorted(r.timestamp_ns for r in imu.collect()) == [10**9, 1001 * 10**6]


POSE = dict(zip(("x", "y", "z", "qw", "qx", "qy", "qz", "vx", "vy", "vz"), ("lane", "row_m", "shelf", "o0", "o1", "o2", "o3", "go_a", "go_b", "go_c"), strict=True))
IMU = dict(zip(("ax", "ay", "az", "gx", "gy", "gz"), ("f1", "f2", "f3", "r1", "r2", "r3"), strict=True))


def messy(root):
    """24 rows at 10 Hz in a clock of nanoseconds whose name says so, under names that no alias has."""
    root.mkdir()
    rows = range(24)
    times = [10**9 + i * 10**8 for i in rows]
    lines = [f"{t},{i * 0.2:.3f},0.5,0.0,1,0,0,0,2.0,0,0,ok" for i, t in zip(rows, times, strict=True)]
    (root / "aisle.csv").write_text("\n".join([",".join(["clock_ns", *POSE.values(), "state"]), *lines]) + "\n")
    lines = [f"{t},0.1,0.2,9.8,{0.001 * i:.4f},0,0,7" for i, t in zip(rows, times, strict=True)]
    (root / "shake.csv").write_text("\n".join([",".join(["clock_ns", *IMU.values(), "slot"]), *lines]) + "\n")
    (root / "mast_images").mkdir()
    for t in times[::4]:
        (root / f"mast_images/m{t}.png").write_bytes(b"\x89PNG")
    return str(root)


def final_messy(profile):
    m = suggest_manifest(profile, dataset_id="d", robot_id="r", session_id="s")
    for s in m["streams"]:
        kind = {"aisle": "pose", "shake": "imu"}.get(s["stream_id"], "camera")
        s |= {"modality": kind, "type": kind, "mapping_status": "final"}
        if kind != "camera":
            s |= {"timestamp": "clock_ns", "timestamp_unit": "ns", "channels": POSE if kind == "pose" else IMU}
    return m | {"mapping_status": "final"}


def test_messy_drop_from_inspection_to_query(spark, tmp_path):
    profile = inspect_dataset(messy(tmp_path / "raw"), spark=spark)
    assert DatasetProfile.from_dict(json.loads(json.dumps(profile.to_dict()))) == profile
    draft = suggest_manifest(profile, dataset_id="d", robot_id="r", session_id="s")
    assert draft["mapping_status"] == "draft" and validate_manifest(draft).valid and validate_manifest(draft).warnings
    with pytest.raises(ValueError):
        ingest_manifest(draft, output_root=tmp_path / "no", spark=spark)
    assert not (tmp_path / "no").exists()
    report = ingest_manifest(final_messy(profile), output_root=tmp_path / "out", row_group_rows=8, spark=spark)
    assert report.row_groups == {"pose": 3, "imu": 3, "camera": 1}
    got = query_managed_dataset(tmp_path / "out", channels=("pos_xyz", "rot_wxyz", "imu_accel"), target_hz=10, enforce_ranges=True, spark=spark)
    assert got.tensor.shape == (24, 10) and got.diagnostics.range_violations == 0


def test_failed_ingest_leaves_nothing(spark, tmp_path):
    profile = inspect_dataset(messy(tmp_path / "raw"), spark=spark)
    good = final_messy(profile)
    (tmp_path / "full").mkdir()
    (tmp_path / "full/x").write_text("x")
    with pytest.raises(FileExistsError):
        ingest_manifest(good, output_root=tmp_path / "full", spark=spark)
    broken = json.loads(json.dumps(good))
    pose = next(s for s in broken["streams"] if s["modality"] == "pose")
    pose["channels"]["x"] = "nowhere"
    with pytest.raises(ValueError, match="nowhere"):
        ingest_manifest(broken, output_root=tmp_path / "out", spark=spark)
    pose["channels"]["x"] = "lane"
    pose["timestamp"] = "state"
    with pytest.raises(ValueError, match="no numbers"):
        ingest_manifest(broken, output_root=tmp_path / "out", spark=spark)
    (tmp_path / "raw/mast_images/frame.png").write_bytes(b"x")
    with pytest.raises(ValueError, match="frame.png"):
        ingest_manifest(good, output_root=tmp_path / "out", spark=spark)
    assert not (tmp_path / "out").exists() and not [p for p in os.listdir(tmp_path) if ".tmp-" in p]


def test_managed_ingest_of_euroc(spark, euroc, tmp_path):
    profile = inspect_dataset(euroc, spark=spark)
    assert profile.adapter_id == "euroc" and {s.modality for s in profile.streams} == {"pose", "imu", "camera"}
    camera = next(s for s in profile.streams if s.modality == "camera")
    assert camera.calibration["resolution"] == [752, 480] and len(camera.calibration["intrinsics"]) == 4 and len(camera.calibration["T_BS"]) == 16
    manifest = suggest_manifest(profile, dataset_id="d", robot_id="r", session_id="s")
    report = ingest_manifest(manifest, output_root=tmp_path / "out", spark=spark)
    assert set(report.row_groups) == {"pose", "imu", "camera"} and report.calibrations["cam0"]["rate_hz"] == 20
    got = query_managed_dataset(tmp_path / "out", target_hz=200, gap_policy="allow", spark=spark)
    assert got.tensor.shape[1] == 10 and got.timestamps_ns[0] == TIMES[0]


def test_manifest_mutations(spark, tmp_path):
    stream = {"stream_id": "p", "type": "pose", "modality": "pose", "source_id": "a", "timestamp": "t", "channels": {"x": "x"}, "units": {}, "frame_id": "b"}
    good = {"version": 1, "dataset_id": "d", "robot_id": "r", "session_id": "s", "sources": [{"source_id": "a", "path": "p", "type": "csv"}], "streams": [stream]}
    assert validate_manifest(good).valid
    for change in ({"version": 2}, {"streams": [stream, stream]}, {"streams": [stream | {"source_id": "z"}]}, {"streams": [stream | {"channels": {"warp": "x"}}]}, {"streams": [stream | {"timestamp": ""}]}):
        assert not validate_manifest(good | change).valid
    two = {"streams": [stream, stream | {"stream_id": "q"}]}
    assert validate_manifest(good | two).valid  # two streams may give the same channel


def test_registry_and_plugins(spark, tmp_path):
    assert [a["adapter_id"] for a in list_adapters()][-2:] == ["generic_dataset", "generic_media_placeholder"]
    held = inspect_dataset(messy(tmp_path / "held"), adapter_id="generic_media_placeholder", spark=spark)
    assert {s.modality for s in held.streams} == {"media"} and held.adapter_id == "generic_media_placeholder"
    assert mapping.modality_of_topic("/odom", "nav_msgs/msg/Odometry") == "pose" and mapping.modality_of_topic("/cam0", "sensor_msgs/CompressedImage") == "camera"
    assert mapping.modality_of_topic("/imu/data", "sensor_msgs/Imu") == "imu" and [mapping.modality_of_name(n) for n in ("rgb_left", "ego.csv", "depth", "x")] == ["camera", "pose", "camera", "media"]
    assert mapping.time_columns(["x", "t", "log_time_ns", "t_ms"]) == ("t", "log_time_ns", "t_ms")
    with pytest.raises(KeyError, match="euroc"):
        get_adapter("nothing")

    class Mine(DatasetAdapter):
        adapter_id = "mine"

        def can_inspect(self, path):
            return path.endswith(".mine")

        def inspect(self, path, spark=None):
            return DatasetProfile(1, path, "mine", (), (), (), "mine")

    register_adapter(Mine())
    assert inspect_dataset("x.mine").adapter_id == "mine"


def test_store(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.txt").write_text("hello")
    (tmp_path / "a/y.txt").write_text("!")
    found = store.list_objects(spark, f"file://{tmp_path}/a")
    assert [o.size for o in found] == [5, 1] and len(store.list_objects(spark, f"file://{tmp_path}/a", 1)) == 1
    store.sync_prefix(spark, f"file://{tmp_path}/a", str(tmp_path / "copy"))
    assert (tmp_path / "copy/b/x.txt").read_text() == "hello"
    body = store.upload_folder(spark, str(tmp_path / "copy"), f"file://{tmp_path}/up")
    assert body["total_bytes"] == 6 and (tmp_path / "up/upload_manifest.json").exists()
    with pytest.raises(ValueError):
        store.relative_part("s3a://b/p", "s3a://b/p/../x")


def test_npy_and_atomic_folder(tmp_path):
    a, b = write_npy(str(tmp_path / "t"), np.ones((2, 3)), np.array([1, 2]))
    assert np.load(a).shape == (2, 3) and read_npy_timestamps(b).tolist() == [1, 2]
    with pytest.raises(ZeroDivisionError), atomic_folder(str(tmp_path / "out")) as tmp:
        open(os.path.join(tmp, "x"), "w").close()
        1 / 0
    assert sorted(os.listdir(tmp_path)) == ["t.timestamps_ns.npy", "t.values.npy"]


def test_nulls_in_managed_tables_are_refused(spark, tmp_path):
    bad = synthetic_pose(spark, 10, 0.5).withColumn("x", F.when(F.col("timestamp_ns") > 0, F.col("x")))
    with pytest.raises(Exception, match="null in column x"):
        write_pose(bad, str(tmp_path / "p"))
    write_pose(synthetic_pose(spark, 100, 1.0), str(tmp_path / "ok"), 50)
    assert len(parquet_files(str(tmp_path / "ok"))) == 1 and spark.read.parquet(str(tmp_path / "ok")).count() == 101
