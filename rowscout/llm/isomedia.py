"""Media columns: payloads as ISO base media files, and their metadata from the boxes alone.

`store` wraps a payload as the samples of one video track of raw 8-bit frames (24 x 24 = 576 bytes a frame by default).
`probe` walks the nested boxes of any such file, decodes the sample tables (stsz, stsc, stco or co64, stts, stss) and,
of fragmented files, the track runs (trex, tfhd, trun), and gives codec, duration and the byte ranges of key frames and
of all samples, without touching the payload. Of several tracks the first video track counts, or the first of any kind.

Cases: a null text counts as empty and is padded like any other. A null file, one without a track or samples, and one
that is cut off or contradicts itself give null metadata and the reason in `error`; nothing raises. Boxes may be nested
DEPTH deep, and no count is believed that the bytes of its box, or of the file, can't hold. Other columns are ignored;
empty in, empty out. Equal payloads give equal files: there are no clocks in them.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import by_size, coalesced_text, pick

#: Boxes that only hold other boxes, by the format's specification.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
DEPTH = 32
BATCH = 4_000_000  # bytes of texts or files that are taken up together
#: The identity matrix of the header boxes, in 16.16 and 2.30 fixed point.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(payload: bytes, side: int = 24, per_chunk: int = 8, key_every: int = 12, timescale: int = 25) -> bytes:
    """An ISO media file whose samples are the payload's frames of side * side bytes."""
    frame = side * side
    count, rest = divmod(len(payload), frame)
    if rest or not count:
        raise ValueError("the payload must be a positive number of frames")
    chunks = -(-count // per_chunk)
    last = count - (chunks - 1) * per_chunk
    groups = [(1, per_chunk)] * (chunks > 1) + ([(chunks, last)] if last != per_chunk or chunks == 1 else [])
    keys = range(1, count + 1, key_every)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")

    def moov(first: int) -> bytes:
        entry = box(
            b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", side, side, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1)
        )
        offsets = (first + k * per_chunk * frame for k in range(chunks))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, count, 1)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(groups)), *(struct.pack(">III", at, n, 1) for at, n in groups)),
            full(b"stsz", struct.pack(">II", frame, count)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, count, 0x55C4, 0))
        hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
        tkhd = full(b"tkhd", struct.pack(">IIIII8xhhhh", 0, 0, 1, 0, count, 0, 0, 0, 0), MATRIX, struct.pack(">II", side << 16, side << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, timescale, count, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head) + box(b"mdat", payload)


def walk(data: memoryview, begin: int, end: int, path: tuple = ()):
    """(path, box begin, body begin, body end) of every box, containers before what they hold."""
    if len(path) >= DEPTH:
        raise ValueError("boxes are nested too deep")
    at = begin
    while at < end:
        if end - at < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} goes beyond what holds it")
        here = (*path, kind)
        yield here, at, at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, here)
        at += size


class Body:
    """Reads the body of a box; what goes beyond it is an error."""

    def __init__(self, view: memoryview, kind: bytes, begin: int, end: int):
        self.view, self.kind, self.at, self.end = view, kind, begin, end

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > self.end:
            raise ValueError(f"box {self.kind!r} is cut off")
        got = struct.unpack_from(form, self.view, self.at)
        self.at += size
        return got

    def numbers(self, count: int, kind: str = ">u4") -> np.ndarray:
        size = count * np.dtype(kind).itemsize
        if self.at + size > self.end:
            raise ValueError(f"box {self.kind!r} is cut off")
        got = np.frombuffer(self.view, kind, count, self.at)
        self.at += size
        return got.astype(np.int64)

    def skip(self, n: int) -> Body:
        self.at += n
        return self

    def flags(self) -> tuple[int, int]:
        (x,) = self.take(">I")
        return x >> 24, x & 0xFFFFFF


def whole_samples(boxes: dict[bytes, Body], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes, key flags and ticks of the samples of a track's tables, in a file of `size` bytes."""
    each, count = boxes[b"stsz"].skip(4).take(">II")
    if each and each * count > size:
        raise ValueError("more samples than the file can hold")
    sizes = np.full(count, each, np.int64) if each else boxes[b"stsz"].numbers(count)
    kind = b"co64" if b"co64" in boxes else b"stco"
    if kind not in boxes:
        raise ValueError("no chunk offsets")
    (chunks,) = boxes[kind].skip(4).take(">I")
    offsets = boxes[kind].numbers(chunks, ">u8" if kind == b"co64" else ">u4")
    (groups,) = boxes[b"stsc"].skip(4).take(">I")
    runs = boxes[b"stsc"].numbers(3 * groups).reshape(-1, 3)
    first, per = runs[:, 0], runs[:, 1]
    if groups and (first[0] != 1 or (np.diff(first) <= 0).any() or first[-1] > chunks):
        raise ValueError("chunk groups are out of order")
    per_chunk = np.repeat(per, np.diff(np.r_[first, chunks + 1])) if groups else np.zeros(0, np.int64)
    if int(per_chunk.sum()) != count:
        raise ValueError("chunks hold other samples than there are sizes")
    before = np.cumsum(sizes) - sizes
    opens = (np.cumsum(per_chunk) - per_chunk)[per_chunk > 0]
    at = np.repeat(offsets[: len(per_chunk)][per_chunk > 0] - before[opens], per_chunk[per_chunk > 0]) + before
    (entries,) = boxes[b"stts"].skip(4).take(">I")
    times = boxes[b"stts"].numbers(2 * entries).reshape(-1, 2)
    keys = np.ones(count, bool)
    if b"stss" in boxes:
        keys[:] = False
        named = boxes[b"stss"].skip(4).numbers(*boxes[b"stss"].take(">I"))
        if (named < 1).any() or (named > count).any():
            raise ValueError("a key frame that is no sample")
        keys[named - 1] = True
    return at, sizes, keys, sum(int(n) * int(d) for n, d in times)


def run_samples(view: memoryview, moofs: list[tuple[int, list[tuple[bytes, int, int]]]], track: int, defaults: tuple[int, int, int]):
    """Offsets, sizes, key flags and ticks of the samples of a track's runs in movie fragments."""
    ats, sizes, keys, ticks = [], [], [], 0
    for moof, boxes in moofs:
        mine, base, end = False, moof, moof
        for kind, a, b in boxes:
            body = Body(view, kind, a, b)
            _, flags = body.flags()
            if kind == b"tfhd":
                (of,) = body.take(">I")
                if flags & 0x1:
                    (base,) = body.take(">Q")
                else:  # without the flag a fragment's data follow those of the one before
                    base = moof if flags & 0x20000 else end
                if flags & 0x2:
                    body.skip(4)
                duration, size, how = (body.take(">I")[0] if flags & bit else d for bit, d in zip((0x8, 0x10, 0x20), defaults, strict=True))
                mine, end = of == track, base
                continue
            (count,) = body.take(">I")
            at = base + body.take(">i")[0] if flags & 0x1 else end
            first = body.take(">I")[0] if flags & 0x4 else None
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if not fields and count > len(view):
                raise ValueError("more samples than the file can hold")
            rows = body.numbers(count * len(fields)).reshape(count, len(fields))
            column = lambda bit, d: rows[:, fields.index(bit)] if bit in fields else np.full(count, d, np.int64)  # noqa: B023, E731
            n, how_each = column(0x200, size), column(0x400, how).copy()
            if first is not None and count:
                how_each[0] = first
            if mine:
                ats.append(at + np.cumsum(n) - n)
                sizes.append(n)
                keys.append(how_each & 0x10000 == 0)
                ticks += int(column(0x100, duration).sum())
            end = at + int(n.sum())
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(ats, np.int64), join(sizes, np.int64), join(keys, bool), ticks


def sample_table(data: bytes) -> dict:
    """Codec, timescale, duration, ticks, and offsets, sizes and key flags of the samples of a file's first video track, or
    of its first track if none is video."""
    view = memoryview(data)
    tracks: list[dict[bytes, tuple[int, int]]] = []
    moofs: list[tuple[int, list]] = []
    extends: list[tuple[int, int]] = []
    for path, begin, a, b in walk(view, 0, len(view)):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], (a, b))
        elif path == (b"moov", b"mvex", b"trex"):
            extends.append((a, b))
        elif path == (b"moof",):
            moofs.append((begin, []))
        elif path[:2] == (b"moof", b"traf") and path[-1] in (b"tfhd", b"trun"):
            moofs[-1][1].append((path[-1], a, b))
    if not tracks:
        raise ValueError("no track")
    video = [t for t in tracks if b"hdlr" in t and bytes(view[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]) == b"vide"]
    boxes = {k: Body(view, k, *x) for k, x in (video or tracks)[0].items()}
    for kind in (b"mdhd", b"stsd", b"stsz", b"stsc", b"stts"):
        if kind not in boxes:
            raise ValueError(f"no box {kind!r}")
    version, _ = boxes[b"mdhd"].flags()
    timescale, duration = boxes[b"mdhd"].skip(16).take(">IQ") if version == 1 else boxes[b"mdhd"].skip(8).take(">II")
    _, codec = boxes[b"stsd"].skip(8).take(">I4s")
    at, sizes, keys, ticks = whole_samples(boxes, len(view))
    if moofs:
        version, _ = boxes[b"tkhd"].flags() if b"tkhd" in boxes else (0, 0)
        (track,) = boxes[b"tkhd"].skip(16 if version == 1 else 8).take(">I") if b"tkhd" in boxes else (1,)
        of = {x[0]: x[2:] for x in (Body(view, b"trex", *x).skip(4).take(">5I") for x in extends)}
        more = run_samples(view, moofs, track, of.get(track, (0, 0, 0)))
        at, sizes, keys = (np.concatenate(x) for x in zip((at, sizes, keys), more[:3], strict=True))
        ticks += more[3]
        duration = max(duration, ticks)  # the header of a fragmented file often says 0
    if not len(at):
        raise ValueError("no samples")
    if (at < 0).any() or (at + sizes > len(view)).any():
        raise ValueError("a sample goes beyond the file")
    return {"codec": codec.decode("latin-1").strip(), "timescale": timescale, "duration": duration, "ticks": ticks, "at": at, "sizes": sizes, "keys": keys}


def sample_bytes(data: bytes, at: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of samples; neighbours are read together."""
    opens = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + sizes[:-1]])
    ends = (at + sizes)[np.r_[opens[1:], len(at)] - 1]
    return b"".join(data[a:b] for a, b in zip(at[opens].tolist(), ends.tolist(), strict=True))


def pad(text: bytes, multiple: int = 576) -> bytes:
    """The text with bytes 255 up to a positive multiple."""
    return text.ljust(max(1, -(-len(text) // multiple)) * multiple, b"\xff")


def store(docs: DataFrame, frame_side: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8), media (the file that holds it, padded)."""

    def run(batches):
        for batch in batches:
            for lo, hi in by_size(batch.column(1), BATCH):
                raw = batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                media = pa.array((wrap(pad(x, frame_side**2), frame_side) for x in raw), pa.binary(), size=len(raw))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(map(len, raw), pa.int64(), size=len(raw)), media], ["doc_id", "n_bytes", "media"])

    return coalesced_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


RANGES = "array<struct<offset: long, length: long>>"


def probe(media: DataFrame, with_payload: bool = False, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, n_bytes (null if absent), media, codec, timescale, duration (ticks), n_samples, key_ranges, error, and,
    if asked for, the payload that the sample ranges hold."""
    kept = {id_col: "long", media_col: "binary"}
    has = "n_bytes" in media.columns
    got = pick(media, **kept, **({"n_bytes": "long"} if has else {}))

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("no file")
            x = sample_table(data)
            body = sample_bytes(data, x["at"], x["sizes"]) if with_payload else None
            keys = [{"offset": a, "length": n} for a, n in zip(x["at"][x["keys"]].tolist(), x["sizes"][x["keys"]].tolist(), strict=True)]
            return x["codec"], x["timescale"], min(x["duration"], (1 << 63) - 1), len(x["at"]), keys, None, body
        except (ValueError, struct.error, IndexError, OverflowError) as e:
            return None, None, None, None, None, str(e) or type(e).__name__, None

    pair = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pair), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "media", "codec", "timescale", "duration", "n_samples", "key_ranges", "error", "payload"]

    def run(batches):
        for whole in batches:
            for lo, hi in by_size(whole.column(1), BATCH):
                batch = whole.slice(lo, hi - lo)
                cols = zip(*(one(x.as_py()) for x in batch.column(1)), strict=True)
                sizes = batch.column(2) if has else pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return got.mapInArrow(
        run,
        f"doc_id long, n_bytes long, media binary, codec string, timescale long, duration long, n_samples long, key_ranges {RANGES}, error string, payload binary",
    )
