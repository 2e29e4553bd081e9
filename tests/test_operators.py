"""Expressions, operators, command line and stream against plain Python."""

import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import rowscout
from rowscout import registry
from rowscout.cli import main
from rowscout.functions import spatial, times
from rowscout.functions.motion import axis_angle, quat_normalize, with_slerp
from rowscout.operators import catalog, gaps, resample
from rowscout.operators.audit import AuditedFile, RangeAuditor, RangeViolationError, Span, preflight, row_group_ids
from rowscout.operators.catalog import _gap_of
from rowscout.plans.predicate import parse
from rowscout.schemas import IMU_CHANNELS, IMU_SCHEMA, POSE_CHANNELS, POSE_SCHEMA
from rowscout.sources.synthetic import synthetic_pose


def test_public_names():
    assert all(getattr(rowscout, n) for n in rowscout.__all__)
    assert rowscout.linear_motion_interpolation_benchmark() == 0
    assert rowscout.slerp_constant_angular_velocity_benchmark() < 1e-7


def test_hilbert_is_a_curve_and_agrees(spark):
    cells = [(x, y) for x in range(32768, 32776) for y in range(32768, 32776)]
    order = sorted(cells, key=lambda c: spatial.hilbert_of(*c))
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(order, order[1:], strict=False))
    rng = random.Random(1)
    points = [(rng.randrange(65536), rng.randrange(65536)) for _ in range(200)]
    got = spark.createDataFrame(points, "x long, y long").select("x", "y", spatial.hilbert(F.col("x"), F.col("y")).alias("d")).collect()
    assert all(r.d == spatial.hilbert_of(r.x, r.y) for r in got)


boxes = st.tuples(*[st.floats(-200, 200) for _ in range(2)], *[st.floats(0, 30) for _ in range(2)])


@given(boxes, boxes)
@settings(max_examples=300, deadline=None)
def test_coarse_never_drops_an_exact_match(a, b):
    ra = spatial.hilbert_range_of(a[0], a[0] + a[2], a[1], a[1] + a[3])
    rb = spatial.hilbert_range_of(b[0], b[0] + b[2], b[1], b[1] + b[3])
    exact = a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]
    if exact:
        assert ra[0] <= rb[1] and rb[0] <= ra[1]


def test_hilbert_range_column_equals_its_cells(spark):
    """Against a look at every cell, at the grid's ends and middle; the work for a box does not grow with its cells."""
    rng = random.Random(4)
    ends = [(-40_000, 12), (32_760, 32), (-16_384, 32), (0, 32), (-20, 32), (40_000, 3)]
    boxes = [(x + rng.randrange(30), rng.randrange(w), y + rng.randrange(30), rng.randrange(h)) for x, w in ends for y, h in ends for _ in range(12)]
    boxes = [(x, x + w, y, y + h) for x, w, y, h in boxes] + [(0, 31, 0, 31), (0, 1023, 5, 5), (0, 1024, 5, 5), (3, 2, 0, 0)]
    box = spark.createDataFrame(boxes, "x0 long, x1 long, y0 long, y1 long")
    got = box.select("*", spatial.hilbert_range(*(F.col(c) for c in box.columns)).alias("h")).collect()
    assert len(got) == len(boxes) and all((r.h.lo, r.h.hi) == spatial.hilbert_range_of(r.x0, r.x1, r.y0, r.y1) for r in got)
    plan = str(box.select(spatial.hilbert_range(*(F.col(c) for c in box.columns)).alias("h"))._jdf.queryExecution().analyzed())
    assert "transform(" not in plan and "sequence(" not in plan


def test_slerp(spark):
    df = spark.createDataFrame([(0.5,)], "t double")
    one, half_turn, back = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)], [F.lit(v) for v in (0.0, 1.0, 0.0, 0.0)], [F.lit(v) for v in (-1.0, 0.0, 0.0, 0.0)]
    r = with_slerp(df, one, half_turn, F.col("t"), ["w", "x", "y", "z"]).first()
    assert np.allclose([r.w, r.x, r.y, r.z], [math.sqrt(0.5), math.sqrt(0.5), 0, 0])
    r = with_slerp(df, one, back, F.col("t"), ["w", "x", "y", "z"]).first()
    assert (r.w, r.x) == (1, 0)
    for bad in ((one, [F.lit(0.0)] * 4, 0.5), (one, one, 1.5)):
        with pytest.raises(Exception, match="quaternion|slerp"):
            with_slerp(df, bad[0], bad[1], F.lit(bad[2]), list("wxyz")).collect()
    q = df.select(*quat_normalize([F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)])).first()
    assert q[0] == 1
    assert df.select(*axis_angle([F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(math.pi))).first()[3] == 1


@given(st.lists(st.integers(0, 10_000), max_size=40))
@settings(max_examples=100, deadline=None)
def test_gap_rule(values):
    got = _gap_of(values, None)
    t = sorted(values)
    d = [b - a for a, b in zip(t, t[1:], strict=False) if b > a]
    nominal = 0
    if d:
        s, m = sorted(d), len(d) // 2
        nominal = s[m] if len(s) % 2 else (s[m - 1] + s[m] + 1) // 2
    big = [x for x in d if x > max(1, 5 * nominal)]
    assert got["nominal_dt_ns"] == nominal and got["gap_count"] == len(big) and got["max_gap_ns"] == max(big, default=0)


def test_gap_metadata_matches_the_file_version(spark):
    rng = random.Random(2)
    rows = [(g, t) for g in range(30) for t in rng.choices(range(200), k=rng.randrange(1, 12))]
    got = {r.g: r for r in gaps.gap_metadata(spark.createDataFrame(rows, "g int, timestamp_ns long"), ["g"]).collect()}
    for g in range(30):
        want = _gap_of([t for h, t in rows if h == g], None)
        assert {k: got[g][k] for k in want} == want, g
    unit = spark.createDataFrame([(0, t) for t in (0, 100, 200, 1000)], "g int, timestamp_ns long")
    r = gaps.gap_metadata(unit, ["g"]).first()
    assert (r.gap_count, r.max_gap_ns, r.max_gap_start_ts_ns, r.max_gap_end_ts_ns, r.nominal_dt_ns) == (1, 800, 200, 1000, 100)


def test_resample_against_numpy_over_many_chunks(spark):
    rng = np.random.default_rng(3)
    t = np.unique(rng.integers(0, 10**9, 300))
    x = rng.normal(size=len(t))
    rows = [(int(a), "r", "s", float(b), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for a, b in zip(t, x, strict=True)]
    poses = spark.createDataFrame(rows, POSE_SCHEMA)
    win = spark.createDataFrame([("s", int(t[0]), int(t[-1]))], "session_id string, start_ts_ns long, end_ts_ns long")
    for per_chunk in (3, 4096):
        got = resample.tensorize(poses, win, ["session_id"], 500, per_chunk).orderBy("k").toPandas()
        grid = np.arange(t[0], t[-1] + 1, 2_000_000)
        assert got.ts_ns.tolist() == grid.tolist() and got.k.tolist() == list(range(len(grid)))
        assert np.allclose(got.x, np.interp(grid, t, x))
    assert list(got.columns)[3:] == list(POSE_CHANNELS)


def test_grid_points_and_what_lies_outside(spark):
    """Grid points are those of uniform_grid; a window that the samples do not cover, or that has none, raises."""
    poses = synthetic_pose(spark, 10, 3.0)
    spans = [(7, 10**9 + 3, 2 * 10**9), (8, 10**9, 10**9), (9, 2 * 10**9, 10**9)]
    win = spark.createDataFrame(spans, "w long, start_ts_ns long, end_ts_ns long")
    each = poses.crossJoin(win.select("w"))
    want = sorted((r.w, r.k, r.ts_ns) for r in resample.uniform_grid(win, ["w"], 300, 7).collect())
    got = resample.tensorize(each, win, ["w"], 300, 7)
    assert sorted((r.w, r.k, r.ts_ns) for r in got.collect()) == want and len(want) > 250
    for start, end, at in ((-5, 10**9, -5), (10**9, 3_100_000_001, 3_003_333_333), (10**10, 2 * 10**10, 10**10)):
        out = spark.createDataFrame([(7, start, end)], "w long, start_ts_ns long, end_ts_ns long")
        with pytest.raises(Exception, match="extrapolation needed at"):
            resample.tensorize(each, out, ["w"], 300, 7).collect()
        kept = resample.tensorize(each, out, ["w"], 300, 7, strict=False).collect()
        inside = [r.ts_ns for r in resample.uniform_grid(out, ["w"], 300, 7).collect() if 0 <= r.ts_ns <= 3 * 10**9]
        assert sorted(r.ts_ns for r in kept) == sorted(inside)
    none = spark.createDataFrame([(99, 0, 10)], "w long, start_ts_ns long, end_ts_ns long")
    with pytest.raises(Exception, match="extrapolation needed at 0"):
        resample.tensorize(each, none, ["w"], 300).collect()


def test_resample_with_sparse_samples_and_ties(spark):
    poses = synthetic_pose(spark, 1, 10.0)
    twice = poses.unionByName(poses.withColumn("x", F.col("x") - 100))  # of equal times the greatest counts
    win = spark.createDataFrame([("session_001", 0, 10**10)], "session_id string, start_ts_ns long, end_ts_ns long")
    got = resample.tensorize(twice, win, ["session_id"], 10, 2).orderBy("k").toPandas()
    assert len(got) == 101 and np.allclose(got.x, 2 * got.ts_ns / 1e9)


def test_predicates():
    p = parse("velocity_magnitude > 1 AND time_overlap(5, 9) and ST_Intersects(position, bbox(0,1,-2.5,3,0,1)) AND velocity_magnitude >= 2.5")
    assert p.speeds == [(">", 1.0), (">=", 2.5)] and p.times == [(5, 9)] and p.boxes == [(0, 1, -2.5, 3, 0, 1)] and p.min_velocity == 2.5
    for bad in ("velocity_magnitude < 1", "velocity_magnitude > 1e3", "time_overlap(9, 5)", "x", "ST_Intersects(position, bbox(1,2))", "velocity_magnitude > 1 OR velocity_magnitude > 2"):
        with pytest.raises(ValueError):
            parse(bad)


def test_auditor():
    a = RangeAuditor(200, [Span(0, 100, 50)], 25)
    assert a.record(110, 10) == "authorized" and a.record(180, 8) == "footer"
    with pytest.raises(RangeViolationError):
        a.record(40, 10)
    assert (a.report()["authorized_bytes"], a.report()["footer_bytes"], a.report()["violations"]) == (10, 8, 1)
    with pytest.raises(RangeViolationError):
        RangeAuditor(200, [Span(0, 100, 50)], 4).record(190, 8)
    a.close_footer()
    with pytest.raises(RangeViolationError):
        a.record(180, 8)
    with pytest.raises(RangeViolationError):
        RangeAuditor(200, [Span(0, 0, 50), Span(1, 50, 50)], 0).record(40, 20)  # not in one span as a whole
    import io

    f = AuditedFile(io.BytesIO(bytes(200)), RangeAuditor(200, [Span(0, 0, 200)], 0))
    assert len(f.read(150)) == 150 and len(f.read(100)) == 50
    with pytest.raises(RangeViolationError):
        f.read()


def test_preflight():
    preflight([1, 0], [Span(0, 0, 5), Span(1, 5, 5)])
    for ids, spans in (([0], [Span(1, 0, 5)]), ([0, 0], [Span(0, 0, 5)]), ([0], [Span(0, 0, 0)]), ([0], [Span(0, 1, 1 << 63)])):
        with pytest.raises(RangeViolationError):
            preflight(ids, spans)
    assert row_group_ids([2, 0, 2], 3) == [0, 2]
    for bad in ([], [3], [-1]):
        with pytest.raises(ValueError):
            row_group_ids(bad, 3)


def test_times(spark):
    df = spark.createDataFrame([("frame_1000000.png", 1403715274302142977), ("a/b/12345.png", -1)], "name string, t long")
    rows = df.select(times.filename_digits(F.col("name")), times.scaled(F.col("t"), 1, True), times.hour_bucket(F.col("t"))).collect()
    assert [r[0] for r in rows] == [1000000, None] and rows[0][1] == 1403715274302142977 and rows[1][2] == -times.HOUR_NS
    assert [times.unit_of_name(n) for n in ("sensor_time", "t_ms", "clock_us", "t_s", "t")] == ["ns", "ms", "us", "s", "ns"]
    guessed = {"header_stamp": "ns", "time_milliseconds": "ms", "microseconds": "us", "seconds": "s", "time_ns": "ns", "Nanoseconds": "ns", "t_sec": "ns", "Elapsed_S": "s"}
    assert {n: times.unit_of_name(n) for n in guessed} == guessed
    assert times.scale_of({"timestamp_unit": "ms", "discovery": {"timestamp_unit": "us"}}) == 1e6
    with pytest.raises(ValueError):
        times.grid_step(0)


def test_files_by_uri(spark, tmp_path):
    """Footers, row groups and ranges by a file:// URI, which goes through pyarrow's file systems like any store."""
    from rowscout.operators.audit import read_range
    from rowscout.sources.rowgroups import open_raw, read_groups

    synthetic_pose(spark, 10, 10.0).coalesce(1).write.parquet(str(tmp_path / "p"))
    path = str(next((tmp_path / "p").glob("*.parquet")))
    uri = f"file://{path}"
    assert open_raw(uri)[1] == os.path.getsize(path) and read_range(uri, 0, 4) == b"PAR1" == read_range(path, 0, 4)
    by_path, by_uri = (catalog.index_files(spark, [x], "pose").drop("file_uri").collect() for x in (path, uri))
    assert by_path == by_uri and len(by_uri) == 1
    span = Span(0, by_uri[0].byte_offset, by_uri[0].byte_length)
    got, report, _ = read_groups(uri, [0], ["timestamp_ns", "x"], [span], 1 << 20)
    assert got.num_rows == by_uri[0].row_count and report["violations"] == 0 and report["footer_reads"] > 0


def test_command_line(spark, tmp_path, capsys):
    assert main(["ingest", "synthetic-parquet", "--hz", "50", "--out", str(tmp_path / "p"), "--row-group-rows", "25"]) == 0
    assert main(["catalog", "build", str(tmp_path / "p"), "--out", str(tmp_path / "c")]) == 0
    assert main(["catalog", "db-build", "--pose", str(tmp_path / "c"), "--out", str(tmp_path / "db")]) == 0
    assert main(["catalog", "explain", "--catalog-db", str(tmp_path / "db"), "--min-velocity", "2"]) == 0
    assert "index_strategy=hilbert" in capsys.readouterr().out
    assert main(["query", "--catalog-db", str(tmp_path / "db"), "--end-ts-ns", "480000000"]) == 0
    assert "shape=[15, 10]" in capsys.readouterr().out
    assert main(["query", "--catalog", str(tmp_path / "c"), "--predicate", "nonsense"]) == 1
    assert main(["dataset", "adapters"]) == 0
    assert main(["demo", "--out", str(tmp_path / "demo")]) == 0
    assert "shape=[15, 10]" in capsys.readouterr().out
    data = next(str(f) for f in (tmp_path / "p").iterdir() if f.suffix == ".parquet")
    assert main(["index", "parquet", data]) == 0 and main(["range-read", "parquet", data, "--limit", "1"]) == 0
    assert main(["validate", "parquet", data, "--row-groups", "1"]) == 0
    assert '"violations": 0' in capsys.readouterr().out
    assert main(["tensor", "row-groups", data, "--row-groups", "0", "--end-ts-ns", "480000000", "--out", str(tmp_path / "t")]) == 0
    assert np.load(tmp_path / "t.values.npy").shape == (15, 10)
    assert main(["gate", "--catalog-db", str(tmp_path / "db"), "--choose", "--iterations", "2", "--min-prune-ratio", "0.5"]) == 0
    assert main(["gate", "--catalog-db", str(tmp_path / "db"), "--iterations", "1", "--max-authorized-bytes", "1"]) == 1
    assert main(["dataset", "demo", "--out", str(tmp_path / "messy")]) == 0
    assert "30," in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        main(["catalog", "build"])
    assert e.value.code == 2


def test_stream_catalog(spark, tmp_path):
    from rowscout.streaming.catalog import late_rows, stream_catalog

    poses = synthetic_pose(spark, 10, 200.0)
    parts = [poses.where(f"timestamp_ns between {k * 50 * 10**9} and {(k + 1) * 50 * 10**9 - 1}") for k in range(4)]
    parts.append(synthetic_pose(spark, 10, 1.0, start_ts_ns=900 * 10**9))  # moves the watermark on
    parts.append(synthetic_pose(spark, 10, 1.0, start_ts_ns=10**9))  # comes too late, and is counted
    for k, part in enumerate(parts):  # files arrive in the order of their times, which is what the stream reads by
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if not f.name.startswith("arrived"):
                os.rename(f, tmp_path / "in" / f"arrived-{k}.parquet")
                os.utime(tmp_path / "in" / f"arrived-{k}.parquet", (1_600_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema(POSE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_catalog(stream).writeStream.format("memory").queryName("cat").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("cat").where("start_ts_ns < 180000000000").orderBy("start_ts_ns").collect()
    assert [r.row_count for r in rows] == [600, 600, 600] and all(r.nominal_dt_ns == 10**8 and r.gap_count == 0 for r in rows)
    assert late_rows(q) > 0


def test_query_returns_raw_sample_on_exact_hit(spark):
    poses = synthetic_pose(spark, 10, 1.0).withColumn("qw", F.lit(2.0))  # not a unit quaternion
    win = spark.createDataFrame([("session_001", 0, 10**9)], "session_id string, start_ts_ns long, end_ts_ns long")
    got = resample.tensorize(poses, win, ["session_id"], 20).orderBy("k").toPandas()
    assert got.qw[0] == 2.0 and got.qw[1] == 1.0


def test_resampled_half_turns_go_the_way_their_samples_say(spark):
    """The cosine of half a turn is 0 but for rounding, and its sign says which way to turn, as in the query's SQL."""
    q = [(math.cos(math.radians(a) / 2), math.sin(math.radians(a) / 2)) for a in range(360)]
    rows = [(t * 10**9, "r", f"{a:03}", 0.0, 0.0, 0.0, w, 0.0, 0.0, z, 0.0, 0.0, 0.0, 0.0) for a in range(360) for t, (w, z) in enumerate((q[a], q[(a + 180) % 360]))]
    poses = spark.createDataFrame(rows, POSE_SCHEMA)
    win = poses.select("session_id").distinct().select("session_id", F.lit(0).cast("long").alias("start_ts_ns"), F.lit(10**9).alias("end_ts_ns"))
    got = {int(r.session_id): r for r in resample.tensorize(poses, win, ["session_id"], 2).where("k = 1").collect()}
    for a in range(360):
        (w, z), (v, y) = q[a], q[(a + 180) % 360]
        turn = -1 if w * v + z * y < 0 else 1
        assert np.allclose((got[a].qw, got[a].qz), ((w + turn * v) * math.sqrt(0.5), (z + turn * y) * math.sqrt(0.5))), a


def test_both_tensors_at_once_equal_the_join_of_each(spark):
    """Ties, far apart samples, windows that inertial samples miss in part or whole, and pieces of a few points."""
    rng = random.Random(9)
    poses, imu, win = [], [], []
    for g in map(str, range(40)):
        n = rng.choice([5, 60])
        t = sorted(rng.choices(range(1000), k=n))
        poses += [(10**6 * a, "r", g, rng.random(), float(a), 0.0, 1.0 + rng.random(), rng.random(), 0.5, rng.random(), 0.0, rng.random(), 0.0, 0.0) for a in t]
        imu += [(10**6 * rng.randrange(-50, 1050), "r", g, *(rng.random() for _ in range(6))) for _ in range(rng.choice([0, 1, 8, 200]))]
        win.append((g, 10**6 * t[0] + rng.choice([0, 1]), 10**6 * t[-1]))
    poses = spark.createDataFrame(poses, POSE_SCHEMA)
    imu = spark.createDataFrame(imu, IMU_SCHEMA)
    win = spark.createDataFrame(win, "session_id string, start_ts_ns long, end_ts_ns long")
    each = [f(d, win, ["session_id"], 400, strict=strict) for f, d, strict in ((resample.tensorize, poses, True), (resample.tensorize_imu, imu, False))]
    want = each[0].join(each[1].drop("ts_ns"), ["session_id", "k"]).select("session_id", "k", "ts_ns", *each[0].columns[3:], *each[1].columns[3:])
    rows = sorted(want.collect())
    assert len(rows) > 3000
    for per_chunk in (3, 50, 4096):
        got = resample.tensorize_both(poses, imu, win, ["session_id"], 400, per_chunk, strict_imu=False)
        assert got.columns == want.columns and sorted(got.collect()) == rows


def test_both_tensors_never_extrapolate(spark):
    poses = synthetic_pose(spark, 10, 3.0)
    imu = poses.select("timestamp_ns", "session_id", *(F.col("x").alias(c) for c in IMU_CHANNELS)).where("timestamp_ns between 500000000 and 2500000000")
    ask = lambda session, start, end, p=poses, i=imu, **how: resample.tensorize_both(p, i, spark.createDataFrame([(session, start, end)], "session_id string, start_ts_ns long, end_ts_ns long"), ["session_id"], 10, 7, **how)
    assert ask("session_001", 10**9, 2 * 10**9).count() == 11
    out = [("session_001", 0, 10**9, {}, 0), ("session_001", 10**9, 3 * 10**9, {}, 2_600_000_000), ("session_001", 2 * 10**9, 4 * 10**9, {"strict_imu": False}, 3_100_000_000)]
    out += [("none", 5, 10**9, {}, 5), ("none", 5, 10**9, {"strict_imu": False}, 5)]
    out += [("session_001", 10**9, 2 * 10**9, {"i": imu.where("false")}, 10**9), ("session_001", 10**9, 2 * 10**9, {"p": poses.where("false"), "strict_imu": False}, 10**9)]
    for session, start, end, how, at in out:
        with pytest.raises(Exception, match=f"extrapolation needed at {at}"):
            ask(session, start, end, **how).collect()
    assert [r.ts_ns for r in ask("session_001", 0, 29 * 10**8, strict_imu=False).orderBy("k").collect()] == list(range(5 * 10**8, 25 * 10**8 + 1, 10**8))


def test_grid_points_are_not_dealt_out(spark):
    """The two streams' grid points, many times the samples, were shuffled to be joined."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["pose_imu_tensor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    filled = next(i for i, line in enumerate(plan.splitlines()) if "Generate explode" in line)
    assert not [line for line in plan.splitlines()[:filled] if "Exchange" in line or "Join" in line]
