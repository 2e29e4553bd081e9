"""Helpers that the operators of this package share: column picking, durable intermediate results, Arrow mapping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
TEXT_BYTES = 16_000_000  # of texts that a worker takes up at a time


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast to the given types, and nothing else.

    Columns are found by exact name first, then ignoring case, and by position afterwards, so that other columns of
    clashing or repeated names do no harm. A missing column is an error.
    """
    names = df.columns
    plain = df.toDF(*(f"_c{i}" for i in range(len(names))))
    out = []
    for name, kind in types.items():
        at = position(names, name)
        out.append(plain[f"_c{at}"].cast(kind).alias(name))
    return plain.select(*out)


def position(names: list[str], name: str) -> int:
    exact = [i for i, x in enumerate(names) if x == name]
    close = exact or [i for i, x in enumerate(names) if x.lower() == name.lower()]
    if not close:
        raise ValueError(f"no column {name!r} among {names}")
    return close[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and Spark runs in one process, as
    in tests, a temporary one; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rowscout-checkpoint-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame, few: bool = False) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage. few: rows that many tasks have made are dealt
    to as few files as their bytes need."""
    shared_dir(df.sparkSession)
    return (df.hint("rebalance") if few else df).checkpoint(eager=True)


#: Rows of a few numbers that may be broadcast.
MOST_BROADCAST = 100_000


def looked_up(big: DataFrame, small: DataFrame, key: str, how: str = "inner", most: int = MOST_BROADCAST) -> DataFrame:
    """big joined to small by a column that is unique in small and may be very uneven in big. Both are read more than
    once, so they should be durable.

    A small table of at most `most` rows is broadcast. Otherwise the keys with more than their share of big's rows
    (there are at most four a shuffle partition) are looked up by broadcast, and only the rest is shuffled by key."""
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), key, how)
    share = max(1000, big.count() // (4 * partitions(big.sparkSession)))
    hot = big.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > share).select(key)
    hot = durable(hot.join(small, key, how))
    if hot.isEmpty():
        return big.join(small, key, how)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small, key, how)
    return big.join(F.broadcast(hot), key).unionByName(cold)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table (zstd) under the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def by_size(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string or binary array that hold about `most` bytes each, at least one row."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(column).fill_null(0)), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield begin, end
        begin = end


def parts_by_bytes(df: DataFrame, most: int) -> int:
    """Into how many parts to deal df, so that one has about `most` bytes of its source files, and every core has one. The
    optimizer's estimate of the size is used; nothing is read. Without an estimate: the shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # sources without a size say 2 ** 63
        return partitions(df.sparkSession)
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // most))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES between Spark and its workers, unless the session says otherwise: a batch of ten
    thousand texts, Spark's default, has no bound in bytes."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def coalesced_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, text string); null texts become empty."""
    bound_batches(df.sparkSession)
    got = pick(df, **{id_col: "long", text_col: "string"})
    return got.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hash_slots(keys, n: int):
    """The shuffle partition, of n, that Spark deals each INT key to: Murmur3 (32 bits, seed 42), modulo n."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        k = turn(np.asarray(keys).astype(np.int32).view(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % n


def even_keys(n: int, slots: int | None = None) -> list[int]:
    """n INT keys that Spark deals evenly to `slots` (by default n) shuffle partitions, where plain 0 .. n - 1 would leave
    some partitions empty and give others several."""
    slots = slots or n
    if max(n, slots) > 20_000:  # the keys are literals of a plan; with so many partitions chance evens out
        return list(range(n))
    wanted = np.arange(n) * slots // max(n, 1) if n < slots else np.arange(n) % slots
    keys = np.arange(16 * max(n, slots))
    while True:
        got = hash_slots(keys, slots)
        order = np.argsort(got, kind="stable")
        first = np.searchsorted(got[order], wanted)
        turn = np.zeros(n, np.int64) if n < slots else np.arange(n) // slots
        at = first + turn
        if n == 0 or (at < len(keys)).all() and (got[order[at]] == wanted).all():
            return keys[order[at]].tolist() if n else []
        keys = np.arange(2 * len(keys))


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A dict of what a worker process keeps between tasks (encoders and the like)."""
    _CACHES.append({})
    return _CACHES[-1]


def free_memory() -> None:
    """Gives back what earlier tasks, of this stage or others, left in this worker process: its caches, and memory that
    Arrow and the C library hold for later."""
    import ctypes

    for cache in _CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
