"""Suffix-array deduplication: bytes that a string of `length` bytes covers, if it also starts in an earlier document.

The suffix array is never built as a whole. The suffixes that matter are the starts of `length`-byte strings, and two
equal strings have the same least-hashed q-gram at the same place (their anchor). So suffixes are first dealt by
anchor, in runs of neighbouring starts that share one:

1. For each part of the corpus, the hashes of its anchors, each once, go to buckets; a bucket tells the parts which
   anchors occur in two documents or more. All other starts can't be repeated and are done with.
2. The runs of repeated anchors go to their buckets with the bytes they cover. Of equal runs in a part only those of the
   least document go on, so that a passage of very many documents sends one run from each part; what the others lose is
   found in the part, as in 3.
3. Suffixes are sorted by bucket-pointer refinement: initial buckets are 6-grams at starts of one anchor, refined to 12,
   24, 48 and `length` bytes by sorting on the bucket pointers of later offsets, each time reusing the pointers just
   refined and leaving out buckets of one. A copy of a run is in the same buckets as the run, so copies are sorted as one.
   Suffixes in one final bucket are the same string; its least document keeps it. Nothing is removed on other grounds.
4. Covered ranges go back to the parts, which cut the bytes out.

An anchor of many occurrences, such as a short line that very many documents have and that each goes on from
differently, would fill one bucket. The parts are told that it is one, and send its strings of `length` bytes singly,
dealt by all their bytes, so that only equal strings meet (of which each part sends one).

A part has about PART_BYTES of the source files. Parts and buckets tell each other at most a row for each pair, and never
more rows than there are anchors or runs.

Bytes are compared, never only hashes: a wrong hash match costs work and changes nothing. The documents are shuffled
once, by part, and that exchange is read by all three passes over them.

Cases: a null text counts as empty; texts shorter than `length` stay whole. A row without an id neither loses bytes nor
takes any from others. Rows that share an id take nothing from each other, since neither id is smaller. Repeated
strings within one document stay. Empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bound_batches, even_keys, free_memory, partitions, parts_by_bytes, position

#: Multipliers of the rolling hash and of its finish: odd 64-bit numbers without structure.
BASE, MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ID_BITS = 40
PART_BYTES = 8 << 20  # of source files whose documents make one part
CHUNK = 1 << 19
REFINE_ROWS = 4096
PORTION_ROWS = 1 << 15  # runs of a part whose bytes are laid out at a time
#: An anchor that occurs so often is dealt string by string, see below.
OFTEN = 2000


def gram_hashes(buf: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams, by doubling, then mixed."""
    power = {1: BASE}
    n = len(buf) - q + 1
    with np.errstate(over="ignore"):
        level, size, parts = (buf.astype(np.uint64) + np.uint64(1)) * MIX2, 1, []
        while size <= q:
            if q & size:
                parts.append((level, size))
            if 2 * size <= q:
                level = level[:-size] * power[size] + level[size:]
                power[2 * size] = power[size] * power[size]
            size *= 2
        out, at = np.zeros(n, np.uint64), 0
        for level, size in reversed(parts):  # longest first
            out = out * power[size] + level[at : at + n]
            at += size
        out ^= out >> np.uint64(32)
        out *= MIX
        out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(buf: np.ndarray, off: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts with one anchor, in documents buf[off[d]:off[d + 1]]: key of the anchor, first start,
    number of starts. The anchor of a start is the leftmost of the least-hashed q-grams of its string, so it depends on
    the string alone."""
    keys, firsts, counts = [], [], []
    for begin, end in chunks_of(off):
        lo, hi = int(off[begin]), int(off[end])
        for a in range(lo, hi, CHUNK) if end == begin + 1 else (lo,):  # a long document goes in overlapping chunks
            b = hi if end > begin + 1 else min(hi, a + CHUNK + length - 1)
            local = np.clip(off[begin : end + 1], a, b) - a
            got = _chunk_runs(buf[a:b], local, length, q)
            if got is not None:
                keys.append(got[0])
                firsts.append(got[1] + a)
                counts.append(got[2])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)


def _chunk_runs(buf, off, length, q):
    many = np.maximum(np.diff(off) - (length - 1), 0)
    total = int(many.sum())
    if not total:
        return None
    h = gram_hashes(buf, q)
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(ranked, length - q + 1)
    starts = np.arange(total, dtype=np.int64) + np.repeat(off[:-1] - (np.cumsum(many) - many), many)
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    with np.errstate(over="ignore"):
        key = h[anchor[new]] * MIX2
    key ^= key >> np.uint64(31)
    return key, starts[new], np.diff(np.r_[new, total])


def split_key(key: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Bucket (one of those given) and shortened key in one number."""
    bucket = buckets[((key & np.uint64(0xFFFFFF)) % np.uint64(len(buckets))).astype(np.int64)].astype(np.uint64)
    return (key >> np.uint64(24)) & np.uint64((1 << ID_BITS) - 1) | bucket << np.uint64(ID_BITS)


def pack_ids(ids: np.ndarray) -> bytes:
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ID_BITS // 8].tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    got = np.zeros((len(raw) * 8 // ID_BITS, 8), np.uint8)
    got[:, : ID_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, ID_BITS // 8)
    return got.view("<u8")[:, 0]


class Part:
    """The documents of a part in a fixed order (by id, then bytes): ids, which have one, bytes and offsets."""

    def __init__(self, table: pa.Table, id_at: int, text_at: int):
        ids = table.column(id_at).combine_chunks()
        text = table.column(text_at).combine_chunks()
        text = pc.fill_null(text, "").cast(pa.large_binary())
        order = pc.sort_indices(pa.table({"i": ids, "t": text}), sort_keys=[("i", "ascending"), ("t", "ascending")])
        self.order = order
        text = text.take(order)
        ids = ids.take(order)
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)
        raw, ends = text.buffers()[2], np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        base = int(ends[0]) if len(ends) else 0
        self.off = (ends - base).astype(np.int64) if len(ends) else np.zeros(1, np.int64)
        size = int(self.off[-1])
        self.buf = np.frombuffer(raw, np.uint8, size, base) if raw is not None and size else np.empty(0, np.uint8)

    def runs(self, length: int, q: int):
        """Runs of the documents that have an id: key, document, start (in the part's bytes), count."""
        last = int(self.known.sum())  # nulls sort last
        key, first, count = runs(self.buf, self.off[: last + 1], length, q)
        return key, np.searchsorted(self.off[: last + 1], first, "right") - 1, first, count


def grouped(values: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def spans_of(starts: np.ndarray, n: int):
    """(begin, end) of groups that begin at `starts` in n rows."""
    return zip(starts.tolist(), np.r_[starts[1:], n][: len(starts)].tolist(), strict=True)


def anchors_of_part(part: Part, pid: int, length: int, q: int, buckets: np.ndarray) -> pa.Table:
    key, doc, _, _ = part.runs(length, q)
    key = split_key(key, buckets)
    order = np.argsort(key, kind="stable")  # documents stay ascending, and ids with them
    key, ids = key[order], part.ids[doc[order]]
    at = grouped(key)
    ends = np.r_[at[1:], len(key)][: len(at)]
    several = ids[at] != ids[ends - 1] if len(at) else np.empty(0, bool)
    times = np.minimum(ends - at, 65535).astype("<u2")
    key = key[at]
    bucket = (key >> np.uint64(ID_BITS)).astype(np.int64)
    edge = grouped(bucket)
    rows = []
    for a, b in spans_of(edge, len(key)):
        part_keys, flags = key[a:b], several[a:b]
        rows.append((int(bucket[a]), pid, pack_ids(part_keys[~flags]), pack_ids(part_keys[flags]), times[a:b][flags].tobytes()))
    return table(rows, ANCHORS)


ANCHORS = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("once", pa.binary()), ("several", pa.binary()), ("times", pa.binary())])
ANSWERS = pa.schema([("pid", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("often", pa.binary())])
REPLIES = pa.schema([("pid", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def repeated_anchors(got: pa.Table) -> pa.Table:
    """For each part, which of its anchors in this bucket occur in two documents or more, and which of them often."""
    pids, once, several, times = (got.column(k).to_pylist() for k in ("pid", "once", "several", "times"))
    bucket = got.column("bucket")[0].as_py()
    ids, owner, count = [], [], []
    for i, (a, b, n) in enumerate(zip(once, several, times, strict=True)):
        for x, c in ((unpack_ids(a), None), (unpack_ids(b), np.frombuffer(n, "<u2"))):
            ids.append(x)
            owner.append(np.full(len(x), i, np.int32))
            count.append(np.ones(len(x), np.int64) if c is None else c.astype(np.int64))
    ids, owner, count = (np.concatenate(x) for x in (ids, owner, count))
    order = np.argsort(ids, kind="stable")
    ids, owner, count = ids[order], owner[order], count[order]
    at = grouped(ids)
    sizes = np.diff(np.r_[at, len(ids)])
    total = np.add.reduceat(count, at) if len(at) else np.empty(0, np.int64)  # 1 for an anchor of a single document
    total = np.repeat(total, sizes)
    keep = total > 1
    ids, owner, often = ids[keep], owner[keep], total[keep] >= OFTEN
    order = np.argsort(owner, kind="stable")
    ids, owner, often = ids[order], owner[order], often[order]
    out = []
    for a, b in spans_of(grouped(owner), len(ids)):
        x, f = ids[a:b], often[a:b]
        out.append((pids[owner[a]], bucket, pack_ids(x[~f]), pack_ids(x[f])))
    return table(out, ANSWERS)


def contents(buf: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes of runs as rows of equal width, zero-filled, with their size in the last column."""
    out = np.zeros((len(first), width), np.uint8)
    step = 1 << 13
    columns = np.arange(width - 1)
    for a in range(0, len(first), step):
        at = first[a : a + step, None] + columns
        inside = columns < size[a : a + step, None]
        out[a : a + step, :-1] = np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0)
    out[:, -1] = size
    return out


def row_width(length: int, q: int) -> int:
    """Bytes that a run covers at most, one for their number, rounded up to whole words."""
    return -(-(2 * length - q + 1) // 8) * 8


def row_hashes(rows: np.ndarray) -> np.ndarray:
    words = rows.view(np.uint64)
    mixed = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            mixed = (mixed ^ words[:, k]) * MIX
            mixed ^= mixed >> np.uint64(32)
    return mixed


def row_classes(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows of one key side by side, and where each class of equal rows begins in it. Should
    different rows share a hash, a class may come in several parts."""
    words, mixed = rows.view(np.uint64), row_hashes(rows)
    order = np.lexsort((mixed, key))
    key, words = key[order], words[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (key[1:] != key[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def runs_of_part(part: Part, pid: int, replies: pa.Table, length: int, q: int, buckets: np.ndarray) -> pa.Table:
    """What a part sends on: runs for their buckets, and the ranges settled within the part for itself."""
    import zstandard

    key, doc, first, count = part.runs(length, q)
    key = split_key(key, buckets)
    picked = []
    for column in ("payload", "often"):
        wanted = [
            unpack_ids(p) | np.uint64(b) << np.uint64(ID_BITS)
            for b, p in zip(replies.column("bucket").to_pylist(), replies.column(column).to_pylist(), strict=True)
        ]
        wanted = np.sort(np.concatenate(wanted)) if wanted else np.empty(0, np.uint64)
        hit = np.zeros(len(key), bool)
        if len(wanted):
            hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
        picked.append([x[hit] for x in (key, doc, first, count)])
    width = row_width(length, q)
    key, _, first, count = picked[0]
    count = count.astype(np.uint8)  # length - q + 1 at most
    if len(picked[1][0]):  # strings of anchors that occur often, each by itself and dealt by all its bytes
        _, _, first1, many = picked[1]
        first1 = np.repeat(first1 - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        key1 = np.empty(len(first1), np.uint64)
        for a in range(0, len(first1), PORTION_ROWS):
            at = first1[a : a + PORTION_ROWS]
            key1[a : a + len(at)] = split_key(row_hashes(contents(part.buf, at, np.full(len(at), length), width)) * MIX2, buckets)
        key, first, count = np.r_[key, key1], np.r_[first, first1], np.r_[count, np.ones(len(first1), np.uint8)]
        del first1, key1
    del picked
    if not len(key):
        return table([], REPLIES)
    order = np.argsort(key, kind="stable")
    key, first, count = key[order], first[order], count[order]
    del order
    ends = np.r_[grouped(key)[1:], len(key)]
    lost = np.zeros(len(part.buf), bool)  # starts that are settled here
    out: list[tuple] = []
    held: list[tuple] = []  # of one bucket
    squeeze = zstandard.ZstdCompressor(level=1)

    def send(bucket: int) -> None:
        keys, *fields, body = zip(*held, strict=True)
        head = np.array([sum(len(k) for k in keys)], "<u8").tobytes()
        out.append((pid, bucket, squeeze.compress(head + b"".join(x.tobytes() for f in (keys, *fields, body) for x in f))))
        held.clear()

    last, a = -1, 0
    while a < len(key):  # keys are taken up whole, as rows of one key are compared; buckets come one after the other
        b = int(ends[min(np.searchsorted(ends, a + PORTION_ROWS), len(ends) - 1)])
        for bucket, *kept in settled(part, key[a:b], first[a:b], count[a:b].astype(np.int64), length, width, lost):
            if held and bucket != last:
                send(last)
            last = bucket
            held.append(tuple(kept))
        a = b
    if held:
        send(last)
    if lost.any():
        edge = np.flatnonzero(np.diff(np.r_[False, lost, False]))  # starts of two documents never touch
        begin, end = edge[::2], edge[1::2]
        doc = np.searchsorted(part.off, begin, "right") - 1
        out.append((pid, -1 - pid, ranges_payload(doc, begin - part.off[doc], end - begin)))
    return table(out, REPLIES)


def settled(part: Part, key: np.ndarray, first: np.ndarray, count: np.ndarray, length: int, width: int, lost: np.ndarray):
    """Of all runs of some keys: marks in `lost` the starts whose string an earlier document of the part has, and returns the
    others by bucket: bucket, keys, ids, begins, documents, sizes, bytes."""
    rows = contents(part.buf, first, count + length - 1, width)
    order, at = row_classes(rows, key)
    key, first, count, rows = key[order], first[order], count[order], rows[order]
    doc = np.searchsorted(part.off, first, "right") - 1
    ids, begin = part.ids[doc], first - part.off[doc]
    sizes = np.diff(np.r_[at, len(key)])
    least = np.minimum.reduceat(ids, at)
    later = ids > np.repeat(least, sizes)
    if later.any():
        several = np.flatnonzero(np.add.reduceat(later, at))
        member, offset, span = members_covered(rows, count + length - 1, key, ids, at, several, length)
        take = later[member]
        start, span = first[member[take]] + offset[take], span[take]
        lost[np.repeat(start - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))] = True
    key, doc, count, rows, ids, begin = (x[~later] for x in (key, doc, count, rows, ids, begin))
    bucket = (key >> np.uint64(ID_BITS)).astype(np.int64)
    found = []
    for a, b in spans_of(grouped(bucket), len(key)):
        size = count[a:b] + length - 1
        body = rows[a:b, :-1][np.arange(rows.shape[1] - 1) < size[:, None]]
        fields = key[a:b].astype("<u8"), ids[a:b].astype("<i8"), begin[a:b].astype("<u8"), doc[a:b].astype("<u4"), size.astype(np.uint8)
        found.append((int(bucket[a]), *fields, body))
    return found


def ranges_payload(doc: np.ndarray, begin: np.ndarray, count: np.ndarray) -> bytes:
    """Ranges of starts, those that touch joined (a text has less than 2 ** 31 bytes, as Arrow has it)."""
    order = np.lexsort((begin, doc))
    doc, begin, count = doc[order], begin[order], count[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] != begin[:-1] + count[:-1])
    at = np.flatnonzero(new)
    count = np.add.reduceat(count, at) if len(at) else count
    return np.stack([x.astype("<u4") for x in (doc[at], begin[at], count)]).tobytes()


def refine(pointer: np.ndarray, shared: np.ndarray, offset: int, ends: np.ndarray, depth: int) -> np.ndarray:
    """Refines bucket pointers in place to a new depth: buckets of more than one suffix are sorted by the pointers
    `offset` later. Returns the positions whose new bucket has others.

    pointer: of every position, the place of its bucket's first suffix among all in sorted order, so the parts of a bucket
    of n take names among the n that were its own; shared: positions whose bucket has others; ends: end of each position's
    row; depth: of the new buckets. Positions too near to their row's end for that depth leave the sort, and no position
    that stays ever looks at their pointers again.
    """
    at = shared[shared + depth <= ends[shared]]
    key = pointer[at].astype(np.uint64) << np.uint64(32) | pointer[at + offset].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    starts = grouped(key)
    sizes = np.diff(np.r_[starts, len(at)])
    whole = (key[starts] >> np.uint64(32)).astype(np.int64)  # the bucket that a part comes from
    opens = grouped(whole)
    from_ = np.repeat(starts[opens], np.diff(np.r_[opens, len(whole)]))
    pointer[at] = np.repeat(whole + starts - from_, sizes)
    return at[np.repeat(sizes > 1, sizes)]


def string_classes(rows: np.ndarray, size: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the starts of all rows (row, start in it): a number, less than the bytes of all rows, that equal strings of
    `length` bytes in rows of one anchor (a number under 65536) share."""
    row_end = np.cumsum(size)
    row_begin = row_end - size
    text = rows[:, :-1][np.arange(rows.shape[1] - 1) < size[:, None]]
    ends = np.repeat(row_end, size)
    depth = 6
    key = np.zeros(len(text), np.uint64)
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    for k in range(depth):
        key = key << np.uint64(8) | padded[k : k + len(text)]
    key = key << np.uint64(16) | np.repeat(anchor.astype(np.uint64), size)
    whole = np.flatnonzero(np.arange(len(text)) + depth <= ends)
    order = whole[np.argsort(key[whole])]
    at = grouped(key[order])
    sizes = np.diff(np.r_[at, len(order)])
    pointer = np.full(len(text), -1, np.int64)
    pointer[order] = np.repeat(at, sizes)
    shared = order[np.repeat(sizes > 1, sizes)]
    # a bucket of one keeps its pointer: no other suffix has it, so nothing that is compared with it can be equal
    while depth < length:
        step = min(depth, length - depth)
        shared = refine(pointer, shared, step, ends, depth + step)
        depth += step
    many = size - length + 1
    row = np.repeat(np.arange(len(size)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return row, start, pointer[row_begin[row] + start]


def owned(rows: np.ndarray, size: np.ndarray, anchor: np.ndarray, least: np.ndarray, length: int):
    """Of different runs with their least ids: ranges of starts (row, first, number) whose strings have one least id
    among all rows, and that id."""
    row, start, name = string_classes(rows, size, anchor, length)
    mine = least[row]
    owner = np.full(int(size.sum()), np.iinfo(np.int64).max)
    np.minimum.at(owner, name, mine)
    owner = owner[name]
    cut = np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])])
    return row[cut], start[cut], np.diff(np.r_[cut, len(row)]), owner[cut]


def members_covered(rows: np.ndarray, size: np.ndarray, key: np.ndarray, ids: np.ndarray, at: np.ndarray, some: np.ndarray, length: int):
    """Ranges of starts (member, first, number) whose strings also start in a document of a smaller id. Members with equal
    rows of one anchor are side by side, class by class (from at[c]), and classes by anchor; `some` are the classes to
    look at. Anchors are taken up whole, as many as make a chunk: equal strings have equal anchors."""
    members = np.diff(np.r_[at, len(key)])
    least = np.minimum.reduceat(ids, at)
    ends = np.r_[grouped(key[at[some]])[1:], len(some)]
    found: list[tuple] = []
    begin = 0
    while begin < len(some):
        end = int(ends[min(np.searchsorted(ends, begin + REFINE_ROWS), len(ends) - 1)])
        part = some[begin:end]
        begin = end
        anchor = np.cumsum(np.r_[0, key[at[part]][1:] != key[at[part]][:-1]])
        row, first, span, owner = owned(rows[at[part]], size[at[part]], anchor & 0xFFFF, least[part], length)
        cls = part[row]
        times = members[cls]  # each range holds for all members of its class, but for the owner's own
        member = np.repeat(at[cls], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        lost = np.repeat(owner, times) < ids[member]
        found.append((member[lost], np.repeat(first, times)[lost], np.repeat(span, times)[lost]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def covered_ranges(got: pa.Table, length: int, q: int) -> pa.Table:
    """From the runs of one bucket: for each part, ranges of starts whose string also starts in a smaller document."""
    import zstandard

    free_memory()
    bucket = got.column("bucket")[0].as_py()
    if bucket < 0:
        return got.select(["pid", "bucket", "payload"])
    pids = got.column("pid").to_pylist()
    fields: list[list[np.ndarray]] = [[] for _ in range(6)]
    bodies = []
    width = row_width(length, q)
    for i, raw in enumerate(got.column("payload").to_pylist()):
        raw = zstandard.decompress(raw)
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        at = 8
        for slot, kind in zip(fields, ("<u8", "<i8", "<u8", "<u4", np.uint8), strict=False):
            slot.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        fields[5].append(np.full(n, i, np.int32))
        size = fields[4][-1].astype(np.int64)
        bodies.append(contents(np.frombuffer(raw, np.uint8, offset=at), np.cumsum(size) - size, size, width))
    key, ids, begin, doc, size, sender = (np.concatenate(x) for x in fields)
    rows, size = np.concatenate(bodies), size.astype(np.int64)
    order, at = row_classes(rows, key)
    key, ids, begin, doc, size, sender = (x[order] for x in (key, ids, begin, doc, size, sender))
    rows = rows[order]
    member, offset, count = members_covered(rows, size, key, ids, at, np.arange(len(at)), length)
    sender, doc, begin = sender[member], doc[member], begin[member].astype(np.int64) + offset
    order = np.argsort(sender, kind="stable")
    sender, doc, begin, count = sender[order], doc[order], begin[order], count[order]
    edge = grouped(sender)
    return table(
        [(pids[sender[a]], bucket, ranges_payload(doc[a:b], begin[a:b], count[a:b])) for a, b in spans_of(edge, len(sender))],
        REPLIES,
    )


def chunks_of(off: np.ndarray):
    """Ranges of documents of about CHUNK bytes each, one document at least."""
    begin = 0
    while begin < len(off) - 1:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + CHUNK, "right")) - 1)
        yield begin, end
        begin = end


def cut_part(part: Part, ranges: pa.Table, length: int) -> tuple[list[bytes], list[int], pa.Array]:
    """Kept bytes, number removed and removed spans of each document, in the part's order, chunk by chunk."""
    got = [np.frombuffer(raw, "<u4").reshape(3, -1) for raw in ranges.column("payload").to_pylist()]
    doc, begin, count = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.uint32) for k in range(3))
    order = np.argsort(doc, kind="stable")
    doc, begin, count = doc[order], begin[order].astype(np.int64), count[order].astype(np.int64)
    kept: list[bytes] = []
    removed: list[int] = []
    starts, sizes, per_doc = [], [], []
    for lo, hi in chunks_of(part.off):
        off = part.off[lo : hi + 1] - part.off[lo]
        buf = part.buf[part.off[lo] : part.off[hi]]
        a, b = np.searchsorted(doc, [lo, hi])
        if a == b:
            kept += [buf[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            removed += [0] * (hi - lo)
            per_doc.append(np.zeros(hi - lo, np.int64))
            continue
        edge = np.zeros(len(buf) + 1, np.int32)
        at = off[doc[a:b] - lo] + begin[a:b]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + count[a:b] + length - 1, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        before = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(gone, out=before[1:])
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
        first[inner] = gone[inner]  # a span ends with its document
        last[inner - 1] = gone[inner - 1]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        home = np.searchsorted(off, begins, "right") - 1
        starts.append(begins - off[home])
        sizes.append(ends - begins)
        per_doc.append(np.bincount(home, minlength=hi - lo))
        removed += (before[off[1:]] - before[off[:-1]]).tolist()
        left, at = buf[~gone].tobytes(), off - before[off]
        kept += [left[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(join(starts)), pa.array(join(sizes))], ["start", "length"])
    spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(join(per_doc))].astype(np.int32)), pairs)
    return kept, removed, spans


def _cut(docs: DataFrame, build, schema: str, id_col: str, text_col: str, length: int, q: int) -> DataFrame:
    """The passes. build(part, sorted table, kept, removed, spans) makes a part's result."""
    if not 8 <= q < length <= 128:
        raise ValueError("8 <= q < length <= 128 is needed")
    bound_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    i, t = position(names, id_col), position(names, text_col)
    plain = plain.withColumn(f"_c{i}", F.col(f"_c{i}").cast("long")).withColumn(f"_c{t}", F.col(f"_c{t}").cast("string"))
    parts = np.array(even_keys(parts_by_bytes(docs, PART_BYTES), partitions(docs.sparkSession)))
    slot = F.pmod(F.xxhash64(f"_c{i}", f"_c{t}"), F.lit(len(parts))).cast("int")
    plain = plain.withColumn("pid", F.get(F.lit(parts.astype(np.int32)), slot) if len(parts) <= 20_000 else slot)
    width = len(names)

    def anchors(key, got):
        free_memory()
        return anchors_of_part(Part(got, i, t), key[0].as_py(), length, q, parts)

    def send(key, got, replies):
        free_memory()
        if not got.num_rows:
            return table([], REPLIES)
        return runs_of_part(Part(got, i, t), key[0].as_py(), replies, length, q, parts)

    def finish(got, ranges):
        free_memory()
        part = Part(got, i, t)
        return build(part, got.select(list(range(width))).take(part.order), *cut_part(part, ranges, length))

    reply_schema = "pid int, bucket int, payload binary"
    groups = plain.groupBy("pid")
    found = groups.applyInArrow(anchors, "bucket int, pid int, once binary, several binary, times binary")
    replies = found.groupBy("bucket").applyInArrow(repeated_anchors, reply_schema + ", often binary")
    sent = groups.cogroup(replies.groupBy("pid")).applyInArrow(send, reply_schema)
    ranges = sent.groupBy("bucket").applyInArrow(lambda got: covered_ranges(got, length, q), reply_schema)
    return groups.cogroup(ranges.groupBy("pid")).applyInArrow(finish, schema)


def cut_repeats(docs: DataFrame, length: int = 50, q: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed, as start and length in bytes), kept (bytes) of every row."""

    def build(part: Part, _: pa.Table, kept: list[bytes], removed: list[int], spans: pa.Array) -> pa.Table:
        ids = pa.array(part.ids, mask=~part.known)
        sizes = pa.array(np.diff(part.off))
        return pa.table([ids, sizes, pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    from .frames import pick

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"
    return _cut(pick(docs, **{id_col: "long", text_col: "string"}), build, schema, id_col, text_col, length, q)


def without_repeats(
    docs: DataFrame, length: int = 50, q: int = 24, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars"
) -> DataFrame:
    """docs with the repeats cut out of their texts; every row stays, if need be with an empty text.

    What is left of a character that a cut went through is dropped, and chars_col, if docs have it, is counted anew. A
    null text stays null.
    """
    names = docs.columns
    t = position(names, text_col)
    n = position(names, chars_col) if chars_col and chars_col.lower() in [x.lower() for x in names] else None
    kinds = {k: f.dataType for k, f in enumerate(docs.schema.fields)}

    def build(part: Part, rows: pa.Table, kept: list[bytes], removed: list[int], spans: pa.Array) -> pa.Table:
        valid = np.asarray(rows.column(t).combine_chunks().is_valid())
        texts = [b.decode("utf-8", "ignore") if ok else None for b, ok in zip(kept, valid, strict=True)]
        rows = rows.set_column(t, f"_c{t}", pa.array(texts, pa.string()))
        if n is not None:
            chars = [len(x) if x is not None else None for x in texts]
            rows = rows.set_column(n, f"_c{n}", pa.array(chars, pa.int64()).cast(rows.schema.field(n).type))
        return rows

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    i = position(names, id_col)
    kinds[t], kinds[i] = StringType(), LongType()
    schema = StructType([StructField(f"_c{k}", kinds[k]) for k in range(len(names))])
    return _cut(docs, build, schema, id_col, text_col, length, q).toDF(*names)
