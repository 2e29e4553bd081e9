"""Row-group-exact reads of Parquet files, optionally under a range auditor.

A task reads one file's selected row groups and nothing else. Under enforcement every byte that pyarrow asks for passes
a RangeAuditor; the footer phase closes when the first row group is materialised. The audit of each file comes back as
a row of its own (kind `audit`), so data and audit are one job. Reads go through pyarrow's file systems by URI
(file, s3 and so on), so nothing is copied to local disks first.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.audit import DEFAULT_FOOTER_BYTES, AuditedFile, RangeAuditor, RangeViolationError, Span, preflight, row_group_ids


def local_path(uri: str) -> str:
    return uri[len("file://") :] if uri.startswith("file://") else uri


def open_raw(uri: str):
    """(seekable file, size) of a URI; bare and file:// paths are local, s3a:// is read as s3://."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file://"):
        path = local_path(uri)
        f = open(path, "rb")  # noqa: SIM115
        f.seek(0, 2)
        return f, f.tell()
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    f = system.open_input_file(path)
    return f, f.size()


def read_groups(uri: str, ids: Sequence[int], schema_names: Sequence[str], spans: Sequence[Span] | None, footer_bytes: int):
    """(table of the row groups sorted by time, with row_group_id; audit report; audit records). spans: enforce them; None: do not."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    raw, size = open_raw(uri)
    with raw:
        auditor = None
        source = raw
        if spans is not None:
            preflight(ids, spans)
            auditor = RangeAuditor(size, spans, footer_bytes)
            source = AuditedFile(raw, auditor)
        try:
            file = pq.ParquetFile(source, pre_buffer=False, buffer_size=0)
            wanted = row_group_ids(ids, file.num_row_groups)
            missing = [n for n in schema_names if n not in file.schema_arrow.names]
            if missing:
                raise ValueError(f"{uri}: columns are missing: {', '.join(missing)}")
            if auditor:
                auditor.close_footer()
            parts = []
            for g in wanted:
                part = file.read_row_group(g, columns=list(schema_names), use_threads=False)
                parts.append(part.append_column("row_group_id", pa.array([g] * part.num_rows, pa.int32())))
            got = pa.concat_tables(parts)
        except OSError as e:
            if auditor and any(r.category == "violation" for r in auditor.reads):
                raise RangeViolationError(str(e)) from e
            raise
    nulls = [n for n in schema_names if got.column(n).null_count]
    if nulls:
        raise ValueError(f"{uri}: nulls in {', '.join(nulls)}")
    got = got.sort_by("timestamp_ns")
    report = auditor.report() if auditor else RangeAuditor(size, []).report()
    records = [vars(r) for r in auditor.reads] if auditor else []
    return got, report, records


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that spark.checkpoint.dir names. Where that is unset and Spark runs in one
    process, in a temporary one; on a cluster an unset folder is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rowscout-checkpoint-"))
    return df.checkpoint(eager=True)


def scan(
    spark: SparkSession,
    schema: StructType,
    selected: Sequence[tuple[str, Sequence[Span]]],
    enforce: bool = False,
    footer_bytes: int = DEFAULT_FOOTER_BYTES,
) -> DataFrame:
    """The selected row groups of files, with columns row_group_id, file_uri and audit (JSON, on one extra row of nulls for each file
    under enforcement)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StringType, StructField

    more = [StructField("row_group_id", IntegerType(), True), *(StructField(c, StringType(), True) for c in ("file_uri", "audit"))]
    out = StructType([StructField(f.name, f.dataType, True) for f in schema] + more)
    rows = [(u, [s.row_group_id for s in spans], [s.offset for s in spans], [s.length for s in spans]) for u, spans in selected]
    listed = spark.createDataFrame(rows, "uri string, ids array<int>, offsets array<long>, lengths array<long>")
    names = [f.name for f in schema]

    def run(batches):
        import pyarrow as pa

        target = to_arrow_schema(out)
        for batch in batches:
            for row in batch.to_pylist():
                spans = [Span(i, o, n) for i, o, n in zip(row["ids"], row["offsets"], row["lengths"], strict=True)]
                got, report, records = read_groups(row["uri"], row["ids"], names, spans if enforce else None, footer_bytes)
                n = got.num_rows
                got = got.append_column("file_uri", pa.array([row["uri"]] * n, pa.string())).append_column("audit", pa.nulls(n, pa.string()))
                yield from got.cast(target).to_batches(max_chunksize=10_000)
                if enforce:
                    told = json.dumps({"report": report, "records": records})
                    yield pa.RecordBatch.from_pylist([{**{f.name: None for f in out}, "file_uri": row["uri"], "audit": told}], schema=target)

    return listed.repartition(max(1, len(rows))).mapInArrow(run, out)
