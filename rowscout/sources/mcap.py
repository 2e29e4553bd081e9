"""MCAP files: a record reader in plain Python, pose decoders, and a small writer.

Payload decoding of JSON is done by Spark expressions; ROS 1 and ROS 2 (CDR, little-endian) payloads are decoded in
Arrow batches. Chunks may be uncompressed or zstd; lz4 needs a codec that pyarrow brings. Messages of other encodings
are passed over.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.motion import velocity_central
from ..schemas import POSE_SCHEMA, typed

#: The format's magic and record opcodes, by its specification.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, DATA_END = 1, 2, 3, 4, 5, 6, 15
MESSAGES_SCHEMA = "topic string, encoding string, schema_name string, log_time long, data binary"


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> int:
        (v,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize(form)
        return v

    def text(self) -> str:
        n = self.take("I")
        self.at += n
        return self.data[self.at - n : self.at].decode()


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        op, size = struct.unpack_from("<BQ", data, at)
        at += 9
        if at + size > len(data):
            raise ValueError("an MCAP record is cut off")
        yield op, data[at : at + size]
        at += size


def _opened(body: bytes) -> bytes:
    c = _Cursor(body)
    c.take("Q"), c.take("Q")
    size = c.take("Q")
    c.take("I")
    method = c.text()
    c.take("Q")
    raw = body[c.at :]
    if method == "":
        return raw
    if method == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    if method == "lz4":
        import pyarrow as pa

        return pa.CompressedInputStream(pa.BufferReader(raw), "lz4").read()
    raise ValueError(f"MCAP chunks compressed with {method!r} can't be read")


def messages(data: bytes) -> Iterator[tuple[str, str, str, int, bytes]]:
    """(topic, encoding, schema name, log time, payload) of every message, in file order."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an MCAP file")
    schemas: dict[int, str] = {0: ""}
    channels: dict[int, tuple[str, str, str]] = {}

    def walk(raw: bytes):
        for op, body in _records(raw):
            c = _Cursor(body)
            if op == SCHEMA:
                key = c.take("H")
                schemas[key] = c.text()
            elif op == CHANNEL:
                key, schema = c.take("H"), c.take("H")
                topic, encoding = c.text(), c.text()
                channels[key] = (topic, encoding, schemas.get(schema, ""))
            elif op == MESSAGE:
                key = c.take("H")
                c.take("I")
                log_time = c.take("Q")
                c.take("Q")
                yield (*channels[key], log_time, body[c.at :])
            elif op == CHUNK:
                yield from walk(_opened(body))
            elif op == FOOTER:
                return

    yield from walk(data[len(MAGIC) :])


def write_mcap(path: str, sent: Iterable[tuple[str, str, str, int, bytes]], chunked: bool = True) -> int:
    """Writes messages (topic, encoding, schema name, log time, payload) to a local file; returns how many."""
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    record = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    schemas: dict[str, int] = {}
    channels: dict[tuple[str, str, str], int] = {}
    out, n, first, last = bytearray(), 0, None, 0
    for topic, encoding, schema, log_time, data in sent:
        if schema not in schemas:
            schemas[schema] = len(schemas) + 1
            out += record(SCHEMA, struct.pack("<H", schemas[schema]) + text(schema) + text("") + struct.pack("<I", 0))
        key = (topic, encoding, schema)
        if key not in channels:
            channels[key] = len(channels) + 1
            out += record(CHANNEL, struct.pack("<HH", channels[key], schemas[schema]) + text(topic) + text(encoding) + struct.pack("<I", 0))
        out += record(MESSAGE, struct.pack("<HIQQ", channels[key], n, log_time, log_time) + data)
        n, first, last = n + 1, log_time if first is None else min(first, log_time), max(last, log_time)
    body = bytes(out)
    if chunked:
        head = struct.pack("<QQQI", first or 0, last, len(body), 0) + text("") + struct.pack("<Q", len(body))
        body = record(CHUNK, head + body)
    with open(path, "wb") as f:
        f.write(MAGIC + record(HEADER, text("") + text("rowscout")) + body + record(DATA_END, bytes(4)) + record(FOOTER, bytes(20)) + MAGIC)
    return n


def write_json_poses(path: str, poses: Iterable[dict], topic: str = "/pose") -> int:
    """Pose rows as flat JSON messages."""
    rows = ((topic, "json", "rowscout.pose.JsonPose", int(p["timestamp_ns"]), json.dumps(p).encode()) for p in poses)
    return write_mcap(path, rows)


def read_messages(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Messages of files that Spark can open, one task for each file, with their place (file, index)."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, i, *m) for i, m in enumerate(messages(data.as_py())) if topic is None or m[0] == topic]
                for a in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[a : a + 10_000], strict=True))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    names = ["file", "index", "topic", "encoding", "schema_name", "log_time", "data"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return raw.mapInArrow(run, f"file string, index long, {MESSAGES_SCHEMA}")


_XYZ, _XYZW = "struct<x: double, y: double, z: double>", "struct<x: double, y: double, z: double, w: double>"
_STAMP = "struct<stamp: struct<sec: long, nanosec: long, nsec: long>>"
_POSE = f"struct<position: {_XYZ}, orientation: {_XYZW}>"
_JSON = (
    "timestamp_ns long, x double, y double, z double, qw double, qx double, qy double, qz double, vx double, vy double, vz double, "
    f"header {_STAMP}, pose struct<position: {_XYZ}, orientation: {_XYZW}, pose: {_POSE}>, "
    f"transform struct<translation: {_XYZ}, rotation: {_XYZW}>, twist struct<twist: struct<linear: {_XYZ}>>"
)


def json_pose_columns(text: Column, log_time: Column) -> dict[str, Column]:
    """Pose columns of a JSON message: flat, PoseStamped, TransformStamped or Odometry.

    Missing numbers of the position or rotation raise; a missing velocity is null. The time is timestamp_ns, else the
    header's stamp, else the log time.
    """
    j = F.from_json(text, _JSON)
    stamp = j["header"]["stamp"]
    ns = F.coalesce(stamp["nanosec"], stamp["nsec"])
    place = lambda a: F.coalesce(j["pose"]["pose"]["position"][a], j["pose"]["position"][a], j["transform"]["translation"][a], j[a])
    turn = lambda a: F.coalesce(j["pose"]["pose"]["orientation"][a], j["pose"]["orientation"][a], j["transform"]["rotation"][a], j[f"q{a}"])
    need = lambda c, n: F.coalesce(c, F.raise_error(F.lit(f"JSON pose without {n}")).cast("double"))
    out = {"timestamp_ns": F.coalesce(j["timestamp_ns"], stamp["sec"] * 1_000_000_000 + ns, log_time)}
    out |= {a: need(place(a), a) for a in "xyz"}
    out |= {f"q{a}": need(turn(a), f"q{a}") for a in "wxyz"}
    out |= {f"v{a}": F.coalesce(j["twist"]["twist"]["linear"][a], j[f"v{a}"]) for a in "xyz"}
    return out


def _skip_text(data: bytes, at: int) -> int:
    return at + 4 + struct.unpack_from("<I", data, at)[0]


def decode_ros1(schema: str, data: bytes) -> tuple:
    """timestamp, x, y, z, qw, qx, qy, qz, vx, vy, vz of a ROS 1 message; velocity is None unless it is an Odometry."""
    kind = schema.rsplit("/", 1)[-1]
    _, sec, nsec = struct.unpack_from("<III", data, 0)
    at = _skip_text(data, 12)
    if kind in ("TransformStamped", "Odometry"):
        at = _skip_text(data, at)
    x, y, z, qx, qy, qz, qw = struct.unpack_from("<7d", data, at)
    v = (None, None, None)
    if kind == "Odometry":
        v = struct.unpack_from("<3d", data, at + 56 + 288)
    return (sec * 1_000_000_000 + nsec, x, y, z, qw, qx, qy, qz, *v)


def decode_cdr(schema: str, data: bytes) -> tuple:
    """The same of a ROS 2 message in little-endian CDR; numbers are aligned from the first byte after the four bytes of
    the encapsulation header, as the format's specification has it and writers of ROS 2 do."""
    if len(data) < 4 or data[1] not in (1, 3):
        raise ValueError("only little-endian CDR can be read")
    kind = schema.rsplit("/", 1)[-1]
    at = 4

    def align(n: int) -> None:
        nonlocal at
        at += -(at - 4) % n

    def text() -> None:
        nonlocal at
        align(4)
        at = _skip_text(data, at)

    sec, nsec = struct.unpack_from("<iI", data, at)
    at += 8
    text()
    if kind in ("TransformStamped", "Odometry"):
        text()
    align(8)
    x, y, z, qx, qy, qz, qw = struct.unpack_from("<7d", data, at)
    v = (None, None, None)
    if kind == "Odometry":
        v = struct.unpack_from("<3d", data, at + 56 + 288)
    return (sec * 1_000_000_000 + nsec, x, y, z, qw, qx, qy, qz, *v)


_COLS = ("timestamp_ns", "x", "y", "z", "qw", "qx", "qy", "qz", "vx", "vy", "vz")


def read_poses(
    spark: SparkSession, path: str, topic: str = "/pose", robot_id: str = "robot_01", session_id: str = "session_001", encodings: tuple[str, ...] = ("json", "ros1", "cdr")
) -> DataFrame:
    """Managed pose rows of a topic. If no message has a velocity, it is derived by central differences; a message
    without one among others that have it gets zeros."""
    sent = read_messages(spark, path, topic).where(F.col("encoding").isin(*encodings))
    cols = json_pose_columns(F.decode("data", "utf-8"), F.col("log_time"))
    plain = sent.where("encoding = 'json'").select("file", "index", *(c.alias(n) for n, c in cols.items()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for f, i, enc, schema, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                rows.append((f, i, *(decode_ros1 if enc == "ros1" else decode_cdr)(schema, data)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 10]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "index", *_COLS])

    schema = "file string, index long, timestamp_ns long, " + ", ".join(f"{c} double" for c in _COLS[1:])
    binary = sent.where("encoding <> 'json'").select("file", "index", "encoding", "schema_name", "data").mapInArrow(run, schema)
    both = plain.unionByName(binary).withColumns({"robot_id": F.lit(robot_id), "session_id": F.lit(session_id)})
    given = F.max(F.when(F.col("vx").isNotNull() | F.col("vy").isNotNull() | F.col("vz").isNotNull(), 1)).over(Window.partitionBy("robot_id", "session_id"))
    both = both.withColumns({"_any": given, **{f"_{c}": F.coalesce(c, F.lit(0.0)) for c in ("vx", "vy", "vz")}})
    derived = velocity_central(both, order=("timestamp_ns", "file", "index"))
    final = derived.withColumns({c: F.when(F.col("_any") == 1, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("vx", "vy", "vz")})
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    return typed(final.withColumn("velocity", speed), POSE_SCHEMA)
