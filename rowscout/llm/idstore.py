"""Token ids as canonical length-limited Huffman files.

The ids of every document go, in ascending order of document id, to files of the format below. The code lengths come
from the global counts of all ids, by package-merge under a limit of `MOST_BITS`; a code is canonical, so the lengths
are all that a reader needs. A file is cut into blocks of `BLOCK` ids that can be decoded independently: the header has
the bit offset of each (a checkpoint). Decoding looks up the next MOST_BITS bits in one table, for all blocks of a file
at once, one id of each block a step.

File: magic, then little-endian u64 counts of documents, of those without an id (which are the last), of ids and of
payload bits, then for each document its id (i64; 0 if it has none) and number of ids (u64), then the bit offset (u64) of
each block, then the payload. Files are the rows of a Parquet table (file number, counts, code lengths, bytes), which
Spark writes to whatever store the path names.

Cases: a null text counts as empty and has the end id alone. Documents without an id come last, in files of their own.
Equal ids are kept side by side. Ids are compared as 64-bit integers. Other columns are ignored; an empty table gives no
files and reads back empty.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import TEXT_BYTES, by_size, coalesced_text, even_keys, partitions, parts_by_bytes, worker_cache

MAGIC = b"ROWHUF2\0"
MOST_BITS = 20
BLOCK = 4096
FILE_BYTES = 16 << 20  # of source files whose documents make one file


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code under the limit, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << most:
        raise ValueError("too many ids for the limit")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(most):
        weights = np.concatenate([leaves, packages])
        sort = np.argsort(weights, kind="stable")
        levels.append(sort < len(leaves))  # whether each item of this level, by weight, is a leaf
        merged = weights[sort]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())  # leaves come in order of weight, so the first n
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each id, and the table from MOST_BITS bits to id << 5 | length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    share = np.int64(1) << (MOST_BITS - size)
    first = np.cumsum(share) - share
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (first >> (MOST_BITS - size)).astype(np.uint32)
    look = np.zeros(1 << MOST_BITS, np.uint32)
    look[: int(share.sum())] = np.repeat(order.astype(np.uint32) << np.uint32(5) | size.astype(np.uint32), share)
    return codes, look


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Payload, bit offset of each block, number of bits."""
    parts, offsets, carry, used = [], [], np.uint64(0), 0  # carry: the last bits, at the top of a word
    total = 0
    for a in range(0, len(ids), 64 * BLOCK):
        part = ids[a : a + 64 * BLOCK]
        size = lengths[part].astype(np.int64)
        end = np.cumsum(size) + used
        begin = end - size
        offsets.append(begin[::BLOCK] - used + total)
        words = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
        words[0] = carry
        code = codes[part].astype(np.uint64)
        at, bit = begin >> 6, begin & 63
        over = bit + size - 64
        inside = over <= 0
        high = np.where(inside, code << np.where(inside, -over, 0).astype(np.uint64), code >> np.where(inside, 0, over).astype(np.uint64))
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[starts]] |= np.bitwise_or.reduceat(high, starts)
        spill = np.flatnonzero(~inside)
        words[at[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
        full, used_now = int(end[-1]) >> 6, int(end[-1]) & 63
        parts.append(words[:full].astype(">u8").tobytes())
        carry = words[full]
        total += int(size.sum())
        used = used_now
    if used:
        parts.append(np.array([carry], ">u8").tobytes()[: -(-used // 8)])
    return b"".join(parts), np.concatenate(offsets) if offsets else np.empty(0, np.int64), total


def decode_bits(payload: bytes, offsets: np.ndarray, count: int, look: np.ndarray) -> np.ndarray:
    """All ids of a payload: one of each block a step."""
    out = np.empty((len(offsets), BLOCK), np.uint32)
    raw = np.zeros(len(payload) + 8, np.uint32)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = offsets.astype(np.int64)
    drop, mask, five = np.uint32(32 - MOST_BITS), np.uint32((1 << MOST_BITS) - 1), np.uint32(31)
    last = len(window) - 1
    for step in range(min(BLOCK, count)):
        if step and len(offsets) > 1 and count - (len(offsets) - 1) * BLOCK == step:
            at = at[:-1]  # the last block is done
        got = look[window[np.minimum(at >> 3, last)] >> (drop - (at & 7).astype(np.uint32)) & mask]
        out[: len(at), step] = got >> np.uint32(5)
        at = at + (got & five)
    return out.reshape(-1)[:count]


def file_image(keys: np.ndarray, nulls: int, sizes: np.ndarray, flat: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """A file of documents in order, the last `nulls` of which have no id; flat has all their ids."""
    payload, offsets, bits = encode_bits(flat, codes, lengths)
    head = MAGIC + struct.pack("<QQQQ", len(keys), nulls, len(flat), bits)
    return b"".join([head, keys.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), payload])


def parse_file(data: bytes, look: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Document ids, how many at the end have none, sizes and all ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    docs, nulls, count, bits = struct.unpack_from("<QQQQ", data, 8)
    at = 40
    keys = np.frombuffer(data, "<i8", docs, at)
    sizes = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    blocks = -(-count // BLOCK)
    at += 16 * docs
    offsets = np.frombuffer(data, "<u8", blocks, at)
    payload = data[at + 8 * blocks :]
    if len(payload) != -(-bits // 8) or int(sizes.sum()) != count:
        raise ValueError("the file is cut off")
    return keys, nulls, sizes, decode_bits(payload, offsets, count, look)


_LOOKS: dict[bytes, np.ndarray] = worker_cache()


def look_up(lengths: bytes) -> np.ndarray:
    """This worker's decoding table for code lengths."""
    if lengths not in _LOOKS:
        _LOOKS.clear()
        _LOOKS[lengths] = canonical(np.frombuffer(lengths, np.uint8))[1]
    return _LOOKS[lengths]


def ranges(base: DataFrame, files: int) -> tuple[np.ndarray, int, int]:
    """Cuts between `files` ranges of the ids, from approximate quantiles of their distance to the least, so that their
    places do not hang on the ids' size; the number of files for rows with an id, and for those without."""
    row = base.agg(F.min("id").alias("least"), F.count("id").alias("known"), F.count("*").alias("n")).first()
    known, none = row["known"], row["n"] - row["known"]
    spare = -(-files * none // max(1, known)) if known and none else files if none else 0
    if files < 2 or not known:
        return np.empty(0, np.int64), files if known else 0, spare
    least = row["least"]
    far = (F.col("id").cast("decimal(20,0)") - F.lit(least).cast("decimal(20,0)")).cast("double")
    cuts = base.where("id is not null").select(far.alias("far")).approxQuantile("far", [k / files for k in range(1, files)], 0.2 / files)
    return np.array([min(least + int(c), (1 << 63) - 1) for c in cuts], np.int64), files, spare


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes the ids of docs to path/files, in ascending order of document id, file by file.

    Texts are encoded once. The ids are shuffled by ranges of document id; the counts and the files are made from that
    one exchange. A file has about FILE_BYTES of the source files, and there is one for each core at least. Ranges are cut and compared as integers; documents of one id that fills several ranges are spread over them,
    and so are those without an id over files that come last.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    top = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if top <= 1 << 16 else "<u4"
    base = coalesced_text(docs, id_col, text_col)
    cuts, files, spare = ranges(base, files or parts_by_bytes(docs, FILE_BYTES))
    files += spare
    slots = np.array(even_keys(files, partitions(spark)), np.int32)  # the key of each file
    file_of = {slot: k for k, slot in enumerate(slots.tolist())}

    def file_at(ids: pa.Array, sizes: np.ndarray) -> np.ndarray:
        value, spread = np.asarray(ids.fill_null(0)), sizes * 2654435761
        low, high = np.searchsorted(cuts, value, "left"), np.searchsorted(cuts, value, "right")
        found = low + spread % (high - low + 1)
        return np.where(np.asarray(ids.is_null()), files - 1 - spread % max(spare, 1), found)

    def run(batches):
        from .wordbpe import encoder, slices_of, with_end

        enc = encoder(tokenizer)
        for batch in batches:
            for lo, hi in by_size(batch.column(1), TEXT_BYTES):
                ids, texts = (batch.column(k).slice(lo, hi - lo) for k in (0, 1))
                flat, first = with_end(*enc.encode_array(texts), end_id)
                sizes = np.diff(first)
                cols = [pa.array(slots[file_at(ids, sizes)]), ids, pa.array(sizes), slices_of(flat.astype(kind), first)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "id", "n", "ids"])

    tokens = base.mapInArrow(run, "part int, id long, n long, ids binary").groupBy("part")

    def numbers(column: pa.Array) -> np.ndarray:
        """All ids of a binary array, in its order."""
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], kind, int(ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0]))

    def count(got: pa.Table) -> pa.Table:
        counts = np.zeros(top, np.int64)
        for column in got.column("ids").chunks:
            if len(column):
                counts += np.bincount(numbers(column), minlength=top)
        used = np.flatnonzero(counts)
        return pa.table({"id": used, "n": counts[used]})

    def codebook(got: pa.Table) -> pa.Table:
        counts = np.zeros(top, np.int64)
        counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
        raw = code_lengths(counts).tobytes()
        return pa.table({"part": pa.array(slots, pa.int32()), "lengths": pa.array([raw] * files, pa.binary())})

    def image(key, got, book):
        if not got.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "n_docs": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "lengths": pa.array([], pa.binary()), "image": pa.array([], pa.binary())})
        got = got.sort_by([("id", "ascending"), ("n", "ascending")])  # nulls at the end
        lengths = book.column("lengths")[0].as_py()
        size = np.frombuffer(lengths, np.uint8)
        keys, n = got.column("id").combine_chunks(), np.asarray(got.column("n").combine_chunks())
        flat = np.concatenate([numbers(c) for c in got.column("ids").chunks if len(c)])
        data = file_image(np.asarray(keys.fill_null(0)), keys.null_count, n, flat, canonical(size)[0], size)
        return pa.table({"part": pa.array([file_of[key[0].as_py()]], pa.int32()), "n_docs": [got.num_rows], "n_tokens": [len(flat)], "lengths": pa.array([lengths], pa.binary()), "image": pa.array([data], pa.binary())})

    counts = tokens.applyInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    books = counts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(codebook, "part int, lengths binary")  # one row for each id of the vocabulary
    images = tokens.cogroup(books.groupBy("part")).applyInArrow(image, "part int, n_docs long, n_tokens long, lengths binary, image binary")
    images.select("part", "n_docs", "n_tokens", "lengths", "image").write.option("compression", "none").parquet(f"{path}/files")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    table = spark.read.parquet(f"{path}/files")
    sizes = sorted((r["part"], r["n_tokens"]) for r in table.select("part", "n_tokens").collect())  # a row for each file
    first, at = {}, 0
    for part, n in sizes:
        first[part] = at
        at += n
    first = spark.sparkContext.broadcast(first)

    def run(batches):
        from .idstore import look_up, parse_file
        from .wordbpe import slices_of

        for batch in batches:
            for k in range(batch.num_rows):
                keys, nulls, counts, ids = parse_file(batch.column(2)[k].as_py(), look_up(batch.column(1)[k].as_py()))
                ends = np.cumsum(counts)
                begin = ends - counts
                start = begin + first.value[batch.column(0)[k].as_py()]
                none, at = np.arange(len(keys)) >= len(keys) - nulls, np.r_[0, ends]
                for a in range(0, len(keys), 2048):
                    b = min(a + 2048, len(keys))
                    raw = slices_of(ids[at[a] : at[b]], at[a : b + 1] - at[a])
                    cols = [pa.array(keys[a:b], mask=none[a:b]), pa.array(start[a:b]), pa.array(counts[a:b]), raw]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    return table.select("part", "lengths", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
