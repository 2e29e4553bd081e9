"""Ids of a tokenizers-library vocabulary, with a cache of pre-tokens.

The library splits a text of the vocabulary used here at white space before anything that reaches across characters, so
the ids of a text are those of its parts between ASCII white space, one after the other, in any script. A chunk of texts
is split by Arrow and every distinct part is looked at once. Most parts are letters of Latin-1 with marks behind; Arrow
cuts those into their two pre-tokens. Other parts are cut by a pattern whose classes are written out (Latin-1) or by the
library's own normalizer and splitter (any script); parts in which a special token could begin go to the library as
they are. Pre-tokens and their ids are kept as Arrow columns, a few dozen bytes each, and what they lack is encoded.

The short cut is taken only where it is provably the same: the tokenizer file has the very steps listed in
`SAME_BY_PART`, its special tokens hold no white space, and the library itself treats each ASCII white-space character
as a border. With any other tokenizer file texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .frames import worker_cache

#: The steps of a tokenizer file under which the ids of a text are those of its white-space parts.
SAME_BY_PART = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "split": {
        "type": "Split",
        "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
}
#: The white space of ASCII, at which Arrow splits.
SPACES = "\t\n\x0b\x0c\r "
#: Latin-1 characters that some libraries take for white space and others do not.
_UNSURE = "\x1c\x1d\x1e\x1f\x85\xa0"
_LETTERS, _NUMBERS = ("".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == k) for k in "LN")
#: The pattern of SAME_BY_PART with its character classes written out for Latin-1.
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


#: A part of letters of Latin-1 and then marks of ASCII, but for ' and <: its pre-tokens are the two, in lower case.
_MARKS = "!-&(-/:;=>?@\\[-`{-~"
_SIMPLE = f"^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+[{_MARKS}]*$"
_CUT = f"^(?P<w>[a-zªµºß-öø-ÿ]+)(?P<t>[{_MARKS}]*)$"


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet, for str.translate: bytes that do not print stand for letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def split_at_spaces(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Texts (none null) split at ASCII white space: the first part of each text and the end, and the parts, coded."""
    lists = pc.ascii_split_whitespace(texts)
    ends = np.asarray(lists.offsets).astype(np.int64)
    return ends - ends[0], lists.flatten().dictionary_encode()


class WordCache:
    """What is known of distinct strings, as two Arrow columns: at most `most` of at most `longest` bytes each.

    When it is full it starts over with what was asked for last, so common strings stay. An entry that is gone is only
    made again."""

    def __init__(self, kind: pa.DataType, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self.words, self.values = pa.array([], pa.string()), pa.array([], kind)

    def look(self, unique: pa.Array, make: Callable[[list[str]], pa.Array]) -> pa.Array:
        """The value of each of the distinct strings; make gives those of strings that are not known."""
        at = pc.index_in(unique, value_set=self.words)
        missing = np.asarray(at.is_null())
        at = np.asarray(at.fill_null(0)).astype(np.int64)
        if not missing.any():
            return self.values.take(pa.array(at))
        fresh = unique.filter(pa.array(missing))
        made = make(fresh.to_pylist())
        at[missing] = len(self.words) + np.arange(len(fresh))
        out = pa.concat_arrays([self.values, made]).take(pa.array(at))
        words, values = [self.words, fresh], [self.values, made]
        if len(self.words) + len(fresh) > self.most:
            words, values = [unique], [out]
        short = pc.less_equal(pc.binary_length(words[-1]), self.longest)
        words[-1], values[-1] = words[-1].filter(short)[: self.most], values[-1].filter(short)[: self.most]
        self.words, self.values = pa.concat_arrays(words), pa.concat_arrays(values)
        return out


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, max_words: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        special = spec.get("added_tokens") or []
        self.by_part = (
            spec.get("normalizer") == SAME_BY_PART["normalizer"]
            and steps[0] == SAME_BY_PART["split"]
            and [x.get("type") for x in steps[1:]] == ["ByteLevel"]
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and all(x["content"].startswith("<|") and len(x["content"].split()) == 1 for x in special)
            and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in special)
            and all(self.library(f"a{c}b") == self.library("a") + self.library("b") for c in SPACES)
        )
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.raw = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.known = WordCache(pa.large_binary(), max_words)
        self.odd: dict[str, bytes] = {}

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def pre_tokens(self, part: str) -> list[str] | None:
        """The pre-tokens of any part, in the byte-level alphabet; None if only the library can tell (special tokens)."""
        if "<|" in part:
            return None
        try:
            part.encode("latin-1")
            plain = not any(map(part.__contains__, _UNSURE))
        except UnicodeEncodeError:
            plain = False
        if plain:
            return [self.lettered(w) for w in _LATIN.findall(part.lower())]
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))
        return [w for w, _ in cut]

    def lettered(self, pre_token: str) -> str:
        """A pre-token in the byte-level alphabet."""
        return pre_token if pre_token.isascii() and pre_token.isprintable() else pre_token.encode().decode("latin-1").translate(self.letters)

    def one(self, lettered: str) -> bytes:
        """The ids of one pre-token in the byte-level alphabet."""
        return b"".join([self.raw[t.id] for t in self.model.tokenize(lettered)])

    def cut(self, unique: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, list[str]]:
        """Distinct parts by kind: which are simple; all distinct pre-tokens of those, lower-cased, and for each part
        the places of its two among them; the other parts."""
        simple = pc.match_substring_regex(unique, _SIMPLE)
        both = pc.extract_regex(pc.utf8_lower(unique.filter(simple)), _CUT)
        words, marks = (pc.struct_field(both, k).dictionary_encode() for k in ("w", "t"))
        pre_tokens = pa.concat_arrays([words.dictionary, marks.dictionary])  # letters and marks have none in common
        other = unique.filter(pc.invert(simple)).to_pylist()
        return np.asarray(simple), pre_tokens, np.asarray(words.indices), np.asarray(marks.indices) + len(words.dictionary), other

    def odd_part(self, part: str) -> bytes:
        """The ids of a part that is not simple, from a cache of 50 000 or else by its pre-tokens."""
        got = self.odd.get(part)
        if got is None:
            words = self.pre_tokens(part)
            got = b"".join(map(self.one, words)) if words is not None else struct.pack(f"<{len(ids := self.library(part))}I", *ids)
            if len(part) <= 64:
                if len(self.odd) >= 50_000:
                    self.odd.clear()
                self.odd[part] = got
        return got

    def ids_of_parts(self, unique: pa.Array) -> pa.Array:
        """The ids of each of the distinct parts, as bytes."""
        simple, pre_tokens, word, mark, other = self.cut(unique)
        ids = self.known.look(pre_tokens, lambda fresh: pa.array([self.one(self.lettered(w)) if w else b"" for w in fresh], pa.large_binary()))
        pair = pc.binary_join_element_wise(ids.take(pa.array(word)), ids.take(pa.array(mark)), pa.scalar(b"", pa.large_binary()))
        if not other:
            return pair
        odd = pa.array(map(self.odd_part, other), pa.large_binary(), size=len(other))
        order = np.empty(len(unique), np.int64)
        order[simple], order[~simple] = np.arange(len(pair)), len(pair) + np.arange(len(odd))
        return pa.concat_arrays([pair, odd]).take(pa.array(order))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (none null), one text after the other, and where each text begins in them, and the end."""
        if not self.by_part:
            ids = [self.library(t) for t in texts.to_pylist()]
            return np.array([i for x in ids for i in x], np.uint32), np.cumsum([0, *map(len, ids)])
        first, coded = split_at_spaces(texts)
        if not len(coded):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ids = self.ids_of_parts(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2], "<u4", int(ends[-1]) // 4) if ends[-1] else np.empty(0, np.uint32)
        return flat, ends[first] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes, four a token."""
        flat, at = self.encode_array(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def with_end(flat: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text, and where each text begins."""
    return np.insert(flat, at[1:], np.uint32(end_id)), at + np.arange(len(at))


def slices_of(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array whose values lie side by side in `raw` (numbers) from at[k] to at[k + 1]; nothing is copied."""
    bounds = at * raw.itemsize
    if bounds[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one batch")
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


_ENCODERS: dict[str, WordEncoder] = worker_cache()


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
