"""Objects of any store that Hadoop knows (file, s3a, hdfs, ...): list, put, get, sync, upload."""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class StoredObject:
    path: str
    size: int
    modified_ms: int


def _fs(spark: SparkSession, uri: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_objects(spark: SparkSession, prefix: str, limit: int = 0) -> list[StoredObject]:
    """Files below a prefix in order of path; limit 0 means all."""
    fs, path = _fs(spark, prefix)
    out = []
    if not fs.exists(path):
        return out
    walk = fs.listFiles(path, True)
    while walk.hasNext():
        s = walk.next()
        out.append(StoredObject(s.getPath().toString(), s.getLen(), s.getModificationTime()))
    out.sort(key=lambda o: o.path)
    return out[:limit] if limit else out


def put_object(spark: SparkSession, local: str, uri: str) -> int:
    fs, path = _fs(spark, uri)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(os.path.abspath(local)), path)
    return os.path.getsize(local)


def get_object(spark: SparkSession, uri: str, local: str) -> int:
    fs, path = _fs(spark, uri)
    os.makedirs(os.path.dirname(os.path.abspath(local)), exist_ok=True)
    fs.copyToLocalFile(False, path, spark._jvm.org.apache.hadoop.fs.Path(os.path.abspath(local)), True)
    return os.path.getsize(local)


def relative_part(root: str, path: str) -> str:
    """path below root; one that would leave it is refused."""
    strip = lambda u: u.split(":", 1)[-1].lstrip("/") if ":" in u else u.lstrip("/")
    base, full = strip(root).rstrip("/"), strip(path)
    if full != base and not full.startswith(base + "/"):
        raise ValueError(f"{path} is not below {root}")
    rest = full[len(base) :].lstrip("/") or posixpath.basename(full)
    if any(p in ("..", "") for p in rest.split("/")) or rest.startswith("/"):
        raise ValueError(f"unsafe path {rest!r}")
    return rest


def sync_prefix(spark: SparkSession, prefix: str, local: str, limit: int = 0) -> list[str]:
    """Copies the objects below a prefix into a local folder, keeping their places."""
    out = []
    for o in list_objects(spark, prefix, limit):
        target = os.path.join(local, relative_part(prefix, o.path))
        get_object(spark, o.path, target)
        out.append(target)
    return out


def upload_folder(spark: SparkSession, local: str, uri: str, manifest: bool = True) -> dict[str, object]:
    """Copies a local folder to a prefix, with a manifest of what was copied beside it."""
    files = []
    for folder, _, names in os.walk(local):
        for name in sorted(names):
            path = os.path.join(folder, name)
            rest = os.path.relpath(path, local).replace(os.sep, "/")
            put_object(spark, path, f"{uri.rstrip('/')}/{rest}")
            files.append({"path": rest, "bytes": os.path.getsize(path)})
    body = {"version": 1, "root": uri, "files": files, "total_bytes": sum(f["bytes"] for f in files)}
    if manifest:
        fs, path = _fs(spark, f"{uri.rstrip('/')}/upload_manifest.json")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(body, indent=2).encode()))
        stream.close()
    return body


def stage_prefix(spark: SparkSession, prefix: str, local: str, limit: int = 0) -> dict[str, object]:
    """A local copy of a prefix, and a manifest of it (also written as stage_manifest.json)."""
    objects = list_objects(spark, prefix, limit)
    paths = sync_prefix(spark, prefix, local, limit)
    body = {"version": 1, "source": prefix, "root": local, "objects": [asdict(o) for o in objects], "files": paths}
    with open(os.path.join(local, "stage_manifest.json"), "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2)
    return body
