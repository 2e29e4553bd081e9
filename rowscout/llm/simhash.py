"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit for each bit position that is 1 in over half the hashes of the text's word shingles. Equal
fingerprints are one node. Two nodes within a small radius agree on c of radius + c blocks of bits at least, so nodes are
dealt to buckets by every choice of c blocks and their values, and compared within buckets only; no pair within the
radius is lost, and with more nodes c grows, so that buckets stay small (see pigeonhole). Where a similarity is asked
for, fingerprints only find candidates, and the exact Jaccard similarity of the shingle sets decides: fingerprints are
longer, the radius is wide, the bands are many, and sets of few shingles meet by a prefix filter, which loses none of
their pairs (see similar_nodes). A bucket of more than `tile` nodes is cut into tiles, and each pair of tiles is a bucket
of its own, so no task holds more than two tiles of a bucket whatever the data.

Within a task the fingerprints are stored vertically: a plane for each bit, holding it for 64 fingerprints a word. The
distances of a whole plane row are counted at once with carry-save adders over the planes; words all of whose lanes
have gone beyond the radius are abandoned on the way. Of a bucket's links only their trees go on, never all pairs of a
group: an edge from each node to the least node of its tree, so that the buckets of different bands say much the same.
The trees are joined into components (see components.py).
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import MOST_BROADCAST, by_size, coalesced_text, durable, free_memory, looked_up, map_batches, partitions, position

SHORT = 40  # shingles of a set that goes through the prefix filter
TILE_BYTES = 16 << 20  # of shingle sets
BLOCK_ROWS = 1 << 17  # that are compared at a time: each step is one call for all groups among them
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of the words of the text, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = WORD.findall(text.encode().lower())  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 of none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def long_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """64 * words bits of the set of hashes: each further word is the fingerprint of the hashes mixed anew."""
    hashes = np.unique(hashes)
    if not len(hashes):
        return bytes(8 * words)
    mixed = np.empty((len(hashes), words), np.uint64)
    with np.errstate(over="ignore"):
        for w in range(words):
            x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (2 * w + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed[:, w] = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.unpackbits(mixed[at : at + 4096].view(np.uint8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id long, text_hash long, fp of every row; a null text counts as empty. fp is a long (the 64 bits as a signed
    number) or, of several words, their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()  # what other stages have left in this worker
        for batch in batches:
            texts, out = batch.column(2), []
            for lo, hi in by_size(texts, 4_000_000):
                for t in texts.slice(lo, hi - lo).to_pylist():
                    hashes = shingle_hashes(t, width)
                    out.append(fingerprint(hashes) if words == 1 else long_fingerprint(hashes, words))
            fps = pa.array(np.array(out, np.uint64).view(np.int64)) if words == 1 else pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["id", "text_hash", "fp"])

    base = coalesced_text(docs, id_col, text_col).select("id", F.xxhash64("text").alias("text_hash"), "text")
    return base.mapInArrow(run, f"id long, text_hash long, fp {'long' if words == 1 else 'binary'}")


def shingle_sets(docs: DataFrame, width: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id long, text_hash long, fp binary, key (128 bits of the set of shingles), n (its size), short (the set itself, as
    ascending hashes, where it has SHORT shingles at most) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        free_memory()  # what other stages have left in this worker
        for batch in batches:
            texts, fps, keys, sizes, short = batch.column(2), [], [], [], []
            for lo, hi in by_size(texts, 4_000_000):
                for t in texts.slice(lo, hi - lo).to_pylist():
                    hashes = np.unique(shingle_hashes(t, width))
                    raw = hashes.tobytes()
                    fps.append(long_fingerprint(hashes, words))
                    keys.append(xxh3_128_digest(raw))
                    sizes.append(len(hashes))
                    short.append(raw if len(hashes) <= SHORT else None)
            columns = [pa.array(fps, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text_hash", "fp", "key", "n", "short"])

    base = coalesced_text(docs, id_col, text_col).select("id", F.xxhash64("text").alias("text_hash"), "text")
    return base.mapInArrow(run, "id long, text_hash long, fp binary, key binary, n int, short binary")


def word_rows(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of words."""
    if pa.types.is_integer(column.type):
        return np.asarray(column).view(np.uint64).reshape(-1, 1)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(len(column), -1)


def planes(fps: np.ndarray) -> np.ndarray:
    """A row of words for each bit; bit l of word w in row b is bit b of fingerprint 64 w + l. The end is filled with 0."""
    out = np.zeros((64 * fps.shape[1], -(-len(fps) // 64)), np.uint64)
    for at in range(0, len(fps), 4096):  # the unpacked bits take eight times the room
        part = fps[at : at + 4096]
        padded = np.zeros((-(-len(part) // 64) * 64, fps.shape[1]), np.uint64)
        padded[: len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        out[:, at // 64 : at // 64 + packed.shape[1] // 8] = np.ascontiguousarray(packed).view(np.uint64)
    return out


def _lane_words(flags: np.ndarray) -> np.ndarray:
    """Booleans as bits of words, 64 lanes a word."""
    padded = np.zeros(-(-len(flags) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum and the carry of three bits, in all lanes."""
    half = a ^ b
    return half ^ c, a & b | half & c


def within(differ, live: np.ndarray, radius: int, bits: int = 64, one_by_one=None) -> np.ndarray:
    """Lanes (as bits of words) whose distance is radius at most.

    differ(lo, hi, at) gives, for bits lo to hi, a row each of the words (numbers at; None: all) of lanes that differ there;
    live has the lanes that count. Seven planes at a time are added up to three-bit numbers, which go onto the counters;
    these are vertical, level k holding bit k of each lane's count. A lane whose count has passed the radius leaves `live`,
    and words without live lanes are abandoned; lanes are looked at from twice the radius on, as few pass it earlier. When
    few lanes are left, one_by_one(lanes), if given, says which of them are within the radius.
    """
    at = np.flatnonzero(live)
    at, live_at = (None, live.copy()) if len(at) == len(live) else (at, live[at])
    count = [np.zeros(len(live_at), np.uint64) for _ in range(bits.bit_length())]
    for b in range(0, bits if len(live_at) else 0, 7):
        p = [*differ(b, min(b + 7, bits), at)]
        p += [np.zeros(len(live_at), np.uint64)] * (7 - len(p))
        s1, c1 = _add(p[0], p[1], p[2])
        s2, c2 = _add(p[3], p[4], p[5])
        one, c3 = _add(s1, s2, p[6])
        two, four = _add(c1, c2, c3)
        carry = np.zeros(len(live_at), np.uint64)
        levels = min(b + 7, bits).bit_length()
        for k, x in enumerate((one, two, four)[:levels]):
            count[k], carry = _add(count[k], x, carry)
        for k in range(3, levels):
            count[k], carry = count[k] ^ carry, count[k] & carry
        if b + 7 < min(bits, 2 * radius):
            continue
        live_at &= ~_over(count, radius)
        if one_by_one and b + 7 < bits and np.bitwise_count(live_at).sum() <= 4 * len(live):
            lanes = _lanes(live_at)
            lanes = lanes if at is None else at[lanes >> 6] << 6 | lanes & 63
            left = np.zeros(64 * len(live), bool)
            left[lanes[one_by_one(lanes)]] = True
            return _lane_words(left)
        if not live_at.all() and (keep := live_at != 0).mean() < 0.75:
            at, live_at, count = np.flatnonzero(keep) if at is None else at[keep], live_at[keep], [c[keep] for c in count]
            if not len(at):
                break
    if at is None:
        return live_at
    out = np.zeros(len(live), np.uint64)
    out[at] = live_at
    return out


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius, compared bit by bit from the top."""
    over, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            same &= count[k]
        else:
            over |= same & count[k]
            same &= ~count[k]
    return over


def linked_pairs(fps: np.ndarray, group: np.ndarray, radius: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links inside groups that lie side by side, as rows i, j: each round compares every row of all groups with the
    one `shift` places on, for as long as groups are that long, and yields what it finds. Groups go by size, so that a
    round has to do with those alone that are long enough. Rows of one label, if given, are known to be joined and are
    left out; the caller may join more of them between rounds."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    by = np.argsort(-sizes, kind="stable")
    by = by[sizes[by] > 1]
    starts, sizes = starts[by], sizes[by]
    ends = np.cumsum(sizes)
    home = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.repeat(starts - (ends - sizes), sizes) + np.arange(len(home))
    fps = fps[rows]
    p = planes(fps)
    longest = int(sizes[0]) if len(sizes) else 0
    for r in range(min(64, longest)):
        moved = None
        for shift in range(r or 64, longest, 64):
            n = int(ends[np.searchsorted(-sizes, -shift) - 1])  # rows of the groups of more than `shift`
            live = home[: n - shift] == home[shift:n]
            if label is not None:
                live &= label[rows[: n - shift]] != label[rows[shift:n]]
            if not live.any():
                continue
            if moved is None:  # later shifts of this r have fewer rows
                moved = p[:, : -(-n // 64)]
                if r:
                    after = np.concatenate([moved[:, 1:], np.zeros((len(p), 1), np.uint64)], axis=1)
                    moved = moved >> np.uint64(r) | after << np.uint64(64 - r)
            live, w = _lane_words(live), shift >> 6

            def differ(lo: int, hi: int, at: np.ndarray | None, k: int = len(live), w: int = w, moved: np.ndarray = moved) -> np.ndarray:
                if at is None:
                    return p[lo:hi, :k] ^ moved[lo:hi, w : w + k]
                return p[lo:hi].take(at, axis=1) ^ moved[lo:hi].take(at + w, axis=1)

            near = lambda lanes, shift=shift: np.bitwise_count(fps[lanes] ^ fps[lanes + shift]).sum(axis=1) <= radius
            hit = _lanes(within(differ, live, radius, len(p), near))
            if len(hit):
                yield rows[hit], rows[hit + shift]


def small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside groups that lie side by side: rows i, j."""
    found = [(np.empty(0, np.int64),) * 2, *linked_pairs(fps, group, radius)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def trees(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The trees of the links inside groups that lie side by side, as an edge from each row to the first of its tree. Rows
    that are joined are not compared again, so a group of near copies costs few rounds."""
    label = np.arange(len(fps))
    for i, j in linked_pairs(fps, group, radius, label):
        roots, at = np.unique(label[np.r_[i, j]], return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        up = np.arange(len(roots))
        while (apart := up[a] != up[b]).any():
            a, b = up[a[apart]], up[b[apart]]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while ((higher := up[up]) != up).any():
                up = higher
        to = np.arange(len(fps))
        to[roots] = roots[up]
        label[:] = to[label]
    below = np.flatnonzero(label != np.arange(len(fps)))
    return label[below], below


def forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """The trees of the links within one group, as an edge from each row to the first of its tree: each row is compared,
    bit-sliced, with the rows that no row has reached yet, and those it reaches wait their turn. Tests hold trees() against it."""
    n, p = len(fps), planes(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
    live = _lane_words(np.ones(n, bool))
    left: list[int] = []
    right: list[int] = []
    for seed in range(n):
        if not live[seed >> 6] >> np.uint64(seed & 63) & np.uint64(1):
            continue
        live[seed >> 6] &= ~(np.uint64(1) << np.uint64(seed & 63))
        wait = [seed]
        while wait and live.any():
            i = wait.pop()
            own = np.uint64(0) - bits[i]
            found = within(lambda lo, hi, at: (p[lo:hi] if at is None else p[lo:hi].take(at, axis=1)) ^ own[lo:hi, None], live, radius, len(p))  # noqa: B023
            live &= ~found
            reached = _lanes(found).tolist()
            left += [seed] * len(reached)
            right += reached
            wait += reached
    return left, right


def links_of_groups(rows: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from nodes to the least of their trees in a group. rows: group, fp, node, with groups side by side and
    nodes ascending, so that the trees of different bands begin at the same nodes and have many edges in common.

    A group has two tiles of a bucket at most, so what is held is bounded. Groups whose numbers collide are compared
    together, which only costs time."""

    def flush(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch | None:
        i, j = trees(fps, keys, radius)
        return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["a", "b"]) if len(i) else None

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0
    for batch in rows:
        held.append((np.asarray(batch.column(0)), word_rows(batch.column(1)), np.asarray(batch.column(2))))
        count += batch.num_rows
        if count < BLOCK_ROWS:
            continue
        keys, fps, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.argmax(keys == keys[-1]))  # the last group may go on
        if cut and (out := flush(keys[:cut], fps[:cut], nodes[:cut])):
            yield out
        held, count = [(keys[cut:], fps[cut:], nodes[cut:])], len(keys) - cut
    if held:
        out = flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if out:
            yield out


def pigeonhole(nodes: DataFrame, radius: int, choose: int = 1) -> DataFrame:
    """fp, node, bucket: a 64-bit fp is cut into radius + choose blocks, and there is a row for every choice of `choose`
    of them, whose bits are the bucket's. Fingerprints within the radius agree on that many blocks at least."""
    blocks = radius + choose
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    choices = list(itertools.combinations(range(blocks), choose))
    keys = []
    for k, chosen in enumerate(choices):
        key, width = F.lit(0).cast("long"), 0
        for c in chosen:
            bits = F.shiftrightunsigned("fp", cuts[c]).bitwiseAND(F.lit((1 << cuts[c + 1] - cuts[c]) - 1))
            key, width = key.bitwiseOR(F.shiftleft(bits, width)), width + cuts[c + 1] - cuts[c]
        keys.append(key * len(choices) + k)
    return nodes.select("fp", "node", F.explode(F.array(*keys)).alias("bucket"))


def blocks_for(n: int, radius: int, tile: int) -> int:
    """How many blocks to choose, so that a bucket of n evenly dealt nodes has a tile at most."""
    return next((c for c in range(1, radius + 1) if n >> 64 * c // (radius + c) <= tile), radius + 1)


def banded(nodes: DataFrame, band_bits: int, turns: int = 2) -> DataFrame:
    """fp, node, bucket: a row for each whole band of band_bits bits of a long fp; then the same of its bits in another
    order, for as many turns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = word_rows(batch.column(0))
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
        bands = bits.shape[1] // band_bits
        orders = [np.random.default_rng(k).permutation(bits.shape[1]) if k else np.arange(bits.shape[1]) for k in range(turns)]
        bits = np.concatenate([bits[:, o[: bands * band_bits]] for o in orders], axis=1)
        bands *= turns
        shaped = bits.reshape(len(rows), bands, band_bits).astype(np.int64)
        keys = (shaped << np.arange(band_bits)).sum(axis=2) * bands + np.arange(bands)
        at = pa.array(np.repeat(np.arange(len(rows)), bands))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys.ravel())], ["fp", "node", "bucket"])

    def small(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                yield run(batch.slice(lo, 512))

    return nodes.select("fp", "node").mapInArrow(small, "fp binary, node long, bucket long")


def with_tiles(dealt: DataFrame, size: F.Column) -> DataFrame:
    """dealt with the number of tiles of each row's bucket; size is an aggregate, how many tiles a bucket fills."""
    large = dealt.groupBy("bucket").agg(F.ceil(size).cast("int").alias("tiles")).where("tiles > 1")
    large = durable(large.select(F.col("bucket").alias("large"), "tiles"))
    many = large.count()
    if not many:  # as a rule; then nothing is joined
        return dealt.withColumn("tiles", F.lit(1))
    large = F.broadcast(large) if many <= MOST_BROADCAST else large  # rows of two numbers
    held = dealt.join(large, F.col("bucket") == F.col("large"), "left").drop("large")
    return held.withColumn("tiles", F.coalesce("tiles", F.lit(1)))


def tile_pairs(held: DataFrame, payload: str) -> DataFrame:
    """grp, payload, node: each pair of tiles of a bucket as a group, with groups side by side and nodes ascending."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    held = held.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), payload, "node"
    )
    return held.repartition(partitions(held.sparkSession), "grp").sortWithinPartitions("grp", "node")


def node_links(dealt: DataFrame, radius: int, tile: int = 2048) -> DataFrame:
    """Edges (a, b) of forests that join the nodes (fp, node, bucket) which share a bucket and whose fingerprints link."""
    held = tile_pairs(with_tiles(dealt, F.count("*") / tile), "fp")
    return held.mapInArrow(lambda rows: links_of_groups(rows, radius), "a long, b long")


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """The trees of the pairs of sets (of distinct numbers) whose Jaccard similarity is `similarity` or more, as an edge
    from each set to the first of its tree. Like forest(), but what a set has in common with all others is counted over lists of the sets that have each member."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    _, member, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(member, kind="stable")]
    first = np.cumsum(count) - count
    live = np.ones(n, bool)
    left: list[int] = []
    right: list[int] = []
    for seed in range(n):
        if not live[seed]:
            continue
        live[seed] = False
        wait = [seed]
        while wait and live.any():
            i = wait.pop()
            own = member[ends[i] - sizes[i] : ends[i]]
            many = count[own]
            at = np.arange(many.sum()) + np.repeat(first[own] - (np.cumsum(many) - many), many)
            common = np.bincount(holders[at], minlength=n)
            found = np.flatnonzero(live & (common / np.maximum(sizes + sizes[i] - common, 1) >= similarity))
            live[found] = False
            left += [seed] * len(found)
            right += found.tolist()
            wait += found.tolist()
    return left, right


def exact_links_of_groups(rows: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from nodes to the least of their trees in a group, by the similarity of their sets. rows: group, set,
    node, with groups side by side and nodes ascending. A group has two tiles of a bucket at most."""
    key, sets, nodes = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            i, j = jaccard_forest(sets, similarity)
            if i:
                of = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(of[i]), pa.array(of[j])], ["a", "b"])

    for batch in rows:
        raw = batch.column(1)
        for k, (group, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if group != key:
                yield from flush()
                key, sets, nodes = group, [], []
            sets.append(np.frombuffer(raw[k].as_py(), np.uint64))
            nodes.append(node)
    yield from flush()


def exact_links(held: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of forests that join the nodes (set, node, bucket, tiles) which share a bucket and are alike."""
    return tile_pairs(held, "set").mapInArrow(lambda rows: exact_links_of_groups(rows, similarity), "a long, b long")


def prefix_length(n: F.Column, similarity: float) -> F.Column:
    """Of two sets of this similarity, put in the same order, the first so many members have one in common."""
    return (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")


def prefixes(nodes: DataFrame, similarity: float) -> DataFrame:
    """set, node, bucket, n: a row for each shingle of the prefix (see prefix_length) of a short set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        take = np.asarray(batch.column(3))
        at = pa.array(np.repeat(np.arange(len(sets)), take))
        keys = np.concatenate([x[:k] for x, k in zip(sets, take.tolist(), strict=True)]).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(2)), pa.array(keys), batch.column(2).take(at)], ["set", "node", "bucket", "n"])

    short = nodes.where(F.col("short").isNotNull() & (F.col("n") > 0))
    short = short.select(F.col("short").alias("set"), "node", "n", prefix_length(F.col("n"), similarity).alias("take"))
    return map_batches(short, run, "set binary, node long, bucket long, n int")


def tiles_of_sets(tile: int) -> F.Column:
    return F.greatest(F.count("*") / tile, F.sum(F.col("n").cast("long") * 8) / TILE_BYTES)


def sets_of(docs: DataFrame, held: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """set, node, bucket, tiles of the nodes (node, text_hash, bucket, tiles), the sets made anew from the texts."""
    held = held.select("node", F.col("text_hash").alias("wanted"), "bucket", "tiles")
    held = F.broadcast(held) if held.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else held  # rows of four numbers
    base = coalesced_text(docs, id_col, text_col)
    texts = base.join(held, F.xxhash64("text") == F.col("wanted")).groupBy("node", "bucket", "tiles").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in by_size(whole.column(0), 4_000_000):
                batch = whole.slice(lo, hi - lo)
                sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *(batch.column(k) for k in (1, 2, 3))], ["set", "node", "bucket", "tiles"])

    return texts.select("text", "node", "bucket", "tiles").mapInArrow(run, "set binary, node long, bucket long, tiles int")


def similar_nodes(
    docs: DataFrame, nodes: DataFrame, similarity: float, width: int, words: int, band_bits: int, tile: int, id_col: str, text_col: str
) -> DataFrame:
    """Edges (a, b) that join the nodes (node, fp, n, short, text_hash) whose exact similarity is `similarity` or more.

    Fingerprints that share a band and are within the wide radius are candidates; the components of the candidates hold
    all that is alike, and within each every pair is compared exactly, until it is known to be joined. Short sets, whose
    fingerprints say little, are also compared wherever two share a shingle of their prefixes.
    """
    loose = node_links(banded(nodes, band_bits), radius_of(similarity, 64 * words), tile)
    labels = components(loose).select("node", F.col("label").alias("bucket"))
    found = durable(looked_up(nodes.select("node", "text_hash", "n"), labels, "node"))
    found = sets_of(docs, with_tiles(found, tiles_of_sets(tile)), width, id_col, text_col)
    short = with_tiles(prefixes(nodes, similarity), tiles_of_sets(tile)).select("set", "node", "bucket", "tiles")
    return exact_links(found, similarity).unionByName(exact_links(short, similarity)).distinct()


def radius_of(similarity: float, bits: int, deviations: float = 4) -> int:
    """Bits that two sets of this Jaccard similarity (and like size) differ in on average, and some standard deviations:
    the share of differing bits is the angle between the sets as vectors, whose cosine is 2 J / (1 + J)."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def near_duplicates(
    docs: DataFrame,
    width: int = 3,
    radius: int = 3,
    tile: int = 2048,
    similarity: float | None = None,
    words: int = 8,
    band_bits: int = 14,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash, fp, component_id (the least doc_id reachable over links, its own included), for every row.

    Without `similarity`, 64-bit fingerprints link within the radius, and none of those links is missed. With it, rows
    link if the sets of their shingles have that Jaccard similarity or more, by exact comparison. Candidates for it come
    from fingerprints of 64 * words bits within mean and four standard deviations of a pair of that similarity, which
    share one of the bands of band_bits bits: by default a pair of similarity 0.8 shares one of 72 with probability
    0.9995, and is also compared where other candidates join it. Pairs with a set of at most 0.8 * SHORT shingles are never missed.

    Cases: null and white-space-only texts have fingerprint zero, and link with one another. Rows of equal ids or
    texts stay rows of their own. A row without an id has a fingerprint and the component of those it links with, but
    never names one; it is null where no row of an id is reachable. Empty in, empty out.
    """
    found = grouped_rows(docs, width, radius, tile, similarity, words, band_bits, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), "text_hash", "fp", "component_id")


def grouped_rows(
    docs: DataFrame, width: int, radius: int, tile: int, similarity: float | None, words: int, band_bits: int, id_col: str, text_col: str
) -> DataFrame:
    """id, text_hash, fp, label (the group's, also where no row has an id), component_id of every row."""
    # a node for each fingerprint, or set of shingles: it exists even where ids are null or repeated; numbered once, as
    # it is checkpointed
    if similarity is None:
        fps = durable(fingerprints(docs, width, 1, id_col, text_col).withColumn("key", F.col("fp")), few=True)
        nodes = fps.groupBy("key", "fp").agg(F.min("id").alias("least"))
    else:
        fps = durable(shingle_sets(docs, width, words, id_col, text_col), few=True)
        nodes = fps.groupBy("key", "fp", "n", "short").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    if similarity is None:
        links = node_links(pigeonhole(nodes, radius, blocks_for(nodes.count(), radius, tile)), radius, tile)
    else:
        links = similar_nodes(docs, nodes, similarity, width, words, band_bits, tile, id_col, text_col)
    labels = components(links)
    joined = looked_up(nodes.select("key", "least", "node"), labels, "node", "left")
    joined = durable(joined.select("key", "least", F.coalesce("label", "node").alias("label")))
    names = durable(joined.groupBy("label").agg(F.min("least").alias("component_id")))
    named = durable(looked_up(joined.select("key", "label"), names, "label"))
    return looked_up(fps.select("id", "text_hash", "fp", "key"), named, "key")


def hex16(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(
    docs: DataFrame,
    width: int = 3,
    radius: int = 3,
    tile: int = 2048,
    similarity: float | None = None,
    words: int = 8,
    band_bits: int = 14,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of docs of each group: that of the least id; of those that share it, or where none has an id, that of the
    least text hash; and of repeated rows of one id and text, any one. A row is told by its id and a hash of its text.
    """
    names = docs.columns
    found = grouped_rows(docs, width, radius, tile, similarity, words, band_bits, id_col, text_col)
    rows = durable(found.groupBy("label", "id", "text_hash").count(), few=True)  # the rows of a text are one group's
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    first = rows.groupBy("label").agg(F.min(order).alias("first")).select("label", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    rows = durable(looked_up(rows, durable(first), "label"))
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = rows.where(~stays).select(F.col("id").alias("_gone"), F.col("text_hash").alias("_text"))
    several = rows.where(stays & (F.col("count") > 1)).select(F.col("id").alias("_gone"), F.col("text_hash").alias("_text"))
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    id_, text = (F.col(f"_c{position(names, c)}") for c in (id_col, text_col))
    plain = plain.withColumn("_id", id_.cast("long")).withColumn("_hash", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        few = keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST  # rows of two numbers
        return rows.join(F.broadcast(keys) if few else keys, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_text")), how)

    kept = matched(plain, gone, "left_anti")
    if not several.isEmpty():
        kept = matched(kept, several, "left_anti").unionByName(matched(kept, several, "left_semi").dropDuplicates(["_id", "_hash"]))
    return kept.drop("_id", "_hash").toDF(*names)
