"""Byte-level BPE on length-bucketed padded numpy matrices.

A text is cut into pre-tokens, each merged on its own. Pre-tokens that the worker has not seen are merged together:
those of like length are the rows of a padded matrix of ids. In each round every row looks up the ranks of its
neighbouring pairs in a hash table, merges its leftmost pair of least rank and closes the gap; rows without a mergeable
pair leave the matrix. A round costs a fixed number of numpy calls for all rows.

With the pattern `BY_SPACE` a space between two characters that are no white space always begins a pre-token, whatever
is before it. So Arrow splits a chunk of texts there, every distinct piece is looked at once, and pieces of letters of
Latin-1 with marks behind are cut into their two pre-tokens by Arrow as well; other pieces are cut by the pattern. With
another pattern the whole text is one piece.

Pre-tokens of more than `LONG` bytes would make a matrix of one wide row; they are merged with a heap over a linked
list, in n log n, with the same result.

Cases: a null text counts as empty. A text of any length is encoded whole. Null, equal and repeated documents are
encoded row by row; other columns are ignored; empty in, empty out. Bytes of any kind have ids, as every single byte is
in the ranks; a rank file without one is refused.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .frames import by_size, coalesced_text, map_batches, pick, worker_cache
from .wordbpe import WordCache

LONG = 256
NONE = np.int32(2**31 - 1)
CHUNK = 8_000_000  # bytes of texts that are encoded together
#: Fixed value: the pattern under which pieces can be cut at single spaces.
BY_SPACE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What is white space to some library, or unsure; a space next to any other character is a border.
_BLANK = "\\x00-\\x20\\x7f-\\xa0\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}"
_MARKS = "!-&(-/:-@\\[-`{-~"
#: A piece of letters of Latin-1 and then marks of ASCII, but for ': its pre-tokens are the two.
_CUT = f"^(?P<w> ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<t>[{_MARKS}]*)$"


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of their merge, which is also its rank."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        values, at = np.array(merged, np.int32), self._slot(keys)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        while len(keys):  # in each round one key settles in each free slot that is wanted
            free = self.keys[at] == empty
            _, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[at[took]], self.values[at[took]] = keys[took], values[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * self.MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        wait = np.flatnonzero((found != keys) & (found != empty))
        at = at[wait]
        while len(wait):
            at = at + 1 & (1 << self.bits) - 1
            found = self.keys[at]
            hit = found == keys[wait]
            out[wait[hit]] = self.values[at[hit]]
            on = ~hit & (found != empty)
            wait, at = wait[on], at[on]
        return out


class ByteBPE:
    """Encoder and decoder of one rank file. The cache has max_words pre-tokens at most."""

    def __init__(self, path: str, pattern: str, max_words: int = 1_000_000):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the ranks lack a single byte")
        self.find, self.by_space = regex.compile(pattern).findall, pattern == BY_SPACE
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known = WordCache(pa.large_binary(), max_words)
        self.spelled = pa.array(self.tokens, pa.large_binary())

    def merge_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most `width` bytes."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        size = np.fromiter(map(len, words), np.int64, n)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        column = np.arange(width)
        rank = np.full((n, width), NONE, np.int32)
        inner = column[:-1] < size[:, None] - 1
        r, c = np.nonzero(inner)
        rank[r, c] = self.pairs.look(ids[r, c], ids[r, c + 1])
        while len(rows):
            at = rank.argmin(axis=1)
            every = np.arange(len(rows))
            merged = rank[every, at]
            done = merged == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, : size[i]].astype("<u4").tobytes()
                go = ~done
                rows, ids, rank, size, at, merged = rows[go], ids[go], rank[go], size[go], at[go], merged[go]
                if not len(rows):
                    break
                most = int(size.max())
                ids, rank, column = ids[:, :most], rank[:, :most], column[:most]
                every = np.arange(len(rows))
            ids[every, at] = merged
            move = column[None, :-1] > at[:, None]  # close the gap at at + 1
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(column[None, :-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            size -= 1
            after = at + 1 < size  # the pair that begins with the merged id
            i = np.flatnonzero(after)
            rank[every, at] = NONE
            rank[i, at[i]] = self.pairs.look(ids[i, at[i]], ids[i, at[i] + 1])
            i = np.flatnonzero(at > 0)  # the pair that ends with it
            rank[i, at[i] - 1] = self.pairs.look(ids[i, at[i] - 1], ids[i, at[i]])
        return out

    def merge_long(self, word: bytes) -> bytes:
        ids = [int(self.byte_ids[b]) for b in word]
        n = len(ids)
        nxt, prev, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        joined = {}

        def rank(a: int, b: int) -> int:
            got = joined.get((a, b))
            if got is None:
                got = joined[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
            return got

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], nxt[i] = r, False, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (s := rank(r, ids[nxt[i]])) >= 0:
                    heapq.heappush(heap, (s, i, r, ids[nxt[i]]))
            if prev[i] >= 0 and (s := rank(ids[prev[i]], r)) >= 0:
                heapq.heappush(heap, (s, prev[i], ids[prev[i]], r))
        return np.array([x for x, ok in zip(ids, live, strict=True) if ok], "<u4").tobytes()

    def learn(self, words: list[str]) -> pa.Array:
        """Ids of words by length bucket: widths double, and a matrix has a bounded number of cells."""
        buckets: dict[int, list[int]] = {}
        raw = [w.encode() for w in words]
        got: list[bytes] = [b""] * len(words)
        for i, b in enumerate(raw):
            if len(b) > LONG:
                got[i] = self.merge_long(b)
            elif b:
                buckets.setdefault(1 << (len(b) - 1).bit_length() if len(b) > 16 else -(-len(b) // 4) * 4, []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 18) // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self.merge_matrix([raw[i] for i in part], width), strict=True):
                    got[i] = ids
        return pa.array(got, pa.large_binary())

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Where each text begins in the pieces, and the end; the distinct pieces, and which of them each piece is."""
        if not self.by_space:
            coded = texts.dictionary_encode()
            return np.arange(len(texts) + 1), coded.dictionary, np.asarray(coded.indices)
        lists = pc.split_pattern(texts, " ")
        first = np.asarray(lists.offsets).astype(np.int64)
        first = first - first[0]
        coded = lists.flatten().dictionary_encode()
        word, distinct = np.asarray(coded.indices), coded.dictionary
        head, tail = (np.asarray(pc.match_substring_regex(distinct, p)) for p in (f"^[^{_BLANK}]", f"[^{_BLANK}]$"))
        begins = np.zeros(len(word) + 1, bool)
        begins[1:-1] = tail[word[:-1]] & head[word[1:]]
        begins[first] = True  # every text has one word at least
        opens = np.zeros(len(word), bool)
        opens[first[:-1]] = True
        at = np.flatnonzero(begins[:-1])
        ends = np.r_[at[1:], len(word)]
        alone = ends - at == 1
        code = 2 * word[at] + ~opens[at]  # a piece of one word, without or with the space before it
        several = np.flatnonzero(~alone)
        spell = [(" " if not opens[a] else "") + " ".join(distinct.take(pa.array(word[a:b])).to_pylist()) for a, b in zip(at[several], ends[several], strict=True)]
        used = np.zeros(2 * len(distinct), bool)
        used[code[alone]] = True
        names = np.flatnonzero(used)
        place = np.cumsum(used) - 1
        odd = pa.array(spell, pa.string()).dictionary_encode()
        out = np.empty(len(at), np.int64)
        out[alone] = place[code[alone]]
        out[several] = len(names) + np.asarray(odd.indices)
        lead = pa.array(["", " "]).take(pa.array(names & 1))
        one = pc.binary_join_element_wise(lead, distinct.take(pa.array(names >> 1)), "")
        return np.searchsorted(at, first), pa.concat_arrays([one, odd.dictionary]), out

    def ids_of_pieces(self, unique: pa.Array) -> pa.Array:
        """The ids of each of the distinct pieces, as bytes."""
        both = pc.extract_regex(unique, _CUT) if self.by_space else pa.nulls(len(unique), pa.struct([("w", pa.string()), ("t", pa.string())]))
        odd = np.asarray(both.is_null())
        cut = [self.find(x) for x in unique.filter(pa.array(odd)).to_pylist()]
        other = pa.array([w for c in cut for w in c], pa.string())
        simple = both.drop_null()
        words = pa.concat_arrays([pc.struct_field(simple, "w"), pc.struct_field(simple, "t"), other]).dictionary_encode()
        ids, place = self.known.look(words.dictionary, self.learn), words.indices
        n = len(simple)
        pair = pc.binary_join_element_wise(ids.take(place[:n]), ids.take(place[n : 2 * n]), pa.scalar(b"", pa.large_binary()))
        if not cut:
            return pair
        raw = ids.take(place[2 * n :])
        ends = np.frombuffer(raw.buffers()[1], np.int64)[: len(raw) + 1][np.cumsum([0, *map(len, cut)])]
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(ends), raw.buffers()[2]])
        order = np.empty(len(unique), np.int64)
        order[~odd], order[odd] = np.arange(n), n + np.arange(len(cut))
        return pa.concat_arrays([pair, joined]).take(pa.array(order))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (none null), one text after the other, and where each text begins in them, and the end."""
        first, unique, which = self.pieces(texts)
        if not len(which):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ids = self.ids_of_pieces(unique).take(pa.array(which))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2], "<u4", int(ends[-1]) // 4) if ends[-1] else np.empty(0, np.uint32)
        return flat, ends[first] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        flat, at = self.encode_array(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode_array(self, flat: np.ndarray, at: np.ndarray) -> pa.Array:
        """The bytes of texts whose ids lie side by side, each from at[k] to at[k + 1]."""
        raw = self.spelled.take(pa.array(flat.astype(np.int64)))
        ends = np.frombuffer(raw.buffers()[1], np.int64)[: len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends[at]), raw.buffers()[2]])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_array(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))[0].as_py()


def spans(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts (ids from at[k] to at[k + 1]) of about `most` ids each, one text at least."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


_CODERS: dict[tuple[str, str], ByteBPE] = worker_cache()


def coder(path: str, pattern: str) -> ByteBPE:
    """This worker's coder for a rank file."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every row, as the public library's encode_ordinary gives them. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bytebpe import coder

        bpe = coder(ranks, pattern)
        for batch in batches:
            for lo, hi in by_size(batch.column(1), CHUNK):
                keys, texts = (batch.column(k).slice(lo, hi - lo) for k in (0, 1))
                flat, at = bpe.encode_array(texts)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([keys, lists], ["doc_id", "ids"])

    return coalesced_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded (bytes). Null ids give null bytes; an id that the ranks lack is an error."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from .bytebpe import coder

        bpe, lists = coder(ranks, pattern), batch.column(1)
        at = np.cumsum(np.r_[0, np.asarray(pc.list_value_length(lists).fill_null(0))], dtype=np.int64)
        flat = np.asarray(pc.cast(lists.flatten(), pa.int32()))
        out = []
        for lo, hi in spans(at, CHUNK // 4):
            out.append(bpe.decode_array(flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]).cast(pa.binary()))
        decoded = pc.if_else(lists.is_valid(), pa.concat_arrays(out), None)
        return pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    got = pick(encoded, **{id_col: "long", ids_col: "array<int>"})
    return map_batches(got, run, "doc_id long, ids array<int>, decoded binary")
