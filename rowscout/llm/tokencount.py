"""Token counts by a two-tier lookup on the map side.

The first tier is a compact table of the token counts of frequent pre-tokens, made once on the driver from a bounded
sample and broadcast; the second is a cache in each worker, filled by encoding what the table misses. Texts are cut into
pre-tokens as in wordbpe, whatever their script, and each distinct pre-token of a chunk of texts is looked up once. No
pre-token is ever shuffled. Both tiers only save work: the counts are those of the library whatever the sample holds.

Cases: a null text counts as empty (0 bytes, 0 tokens). Null, repeated and equal documents are counted row by row; other
columns are ignored; an empty table gives an empty result. Only parts of a text (between white space) in which a special
token could begin go to the library as they are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import TEXT_BYTES, by_size, coalesced_text, map_batches, worker_cache


def frequent_lengths(texts: list[str], tokenizer: str, most: int = 16384, longest: int = 32) -> tuple[bytes, bytes]:
    """The table's compact form: pre-tokens (in the byte-level alphabet) joined by line feeds, and a byte for the count
    of each. At most `most` pre-tokens of at most `longest` characters and 255 tokens, so 2 * longest * most bytes."""
    from .wordbpe import encoder

    enc = encoder(tokenizer)
    seen: Counter[str] = Counter()
    for part, n in Counter(p for t in texts for p in t.split()).items():
        for w in (enc.pre_tokens(part) if enc.by_part else None) or ():
            seen[w] += n
    words = [w for w, _ in seen.most_common() if len(w) <= longest][:most]
    sized = [(w, len(enc.one(w)) // 4) for w in words]
    sized = [(w, n) for w, n in sized if n < 256]
    return "\n".join(w for w, _ in sized).encode(), bytes(n for _, n in sized)


class Counts:
    """Counts of one worker: the table of frequent pre-tokens, then a WordCache of at most max_words others.

    asked: how many distinct pre-tokens were looked up so far; hits: how many the table had; misses: how many had to be
    encoded; whole: parts that went to the library as they were."""

    def __init__(self, tokenizer: str, table: tuple[bytes, bytes], max_words: int = 1_000_000):
        from .wordbpe import WordCache, encoder

        self.enc = encoder(tokenizer)
        words = table[0].decode().split("\n") if table[1] else []
        self.words = pa.array(words, pa.string())
        self.sizes = np.frombuffer(table[1], np.uint8).astype(np.int64)
        self.known = WordCache(pa.int64(), max_words)
        self.asked = self.hits = self.misses = self.whole = 0

    def encoded(self, lettered: list[str]) -> pa.Array:
        self.misses += len(lettered)
        return pa.array([len(self.enc.one(w)) // 4 if w else 0 for w in lettered], pa.int64())

    def lengths(self, pre_tokens: pa.Array) -> np.ndarray:
        """Token counts of distinct pre-tokens in the byte-level alphabet: the table's, then the cache's, then encoded."""
        at = pc.index_in(pre_tokens, value_set=self.words)
        missing = np.asarray(at.is_null())
        out = np.zeros(len(pre_tokens), np.int64)
        out[~missing] = self.sizes[np.asarray(at.drop_null())]
        self.asked, self.hits = self.asked + len(out), self.hits + int((~missing).sum())
        if missing.any():
            out[missing] = np.asarray(self.known.look(pre_tokens.filter(pa.array(missing)), self.encoded))
        return out

    def of_parts(self, unique: pa.Array) -> np.ndarray:
        """Token counts of the distinct parts of a chunk."""
        simple, words, word, mark, other = self.enc.cut(unique)
        if not pc.all(pc.string_is_ascii(words)).as_py():
            words = pa.array(map(self.enc.lettered, words.to_pylist()), pa.string(), size=len(words))
        n = self.lengths(words)
        out = np.zeros(len(unique), np.int64)
        out[simple] = n[word] + n[mark]
        if other:
            cut = list(map(self.enc.pre_tokens, other))
            coded = pa.array([w for c in cut if c for w in c], pa.string()).dictionary_encode()
            n = self.lengths(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.empty(0, np.int64)
            ends = np.cumsum([0, *(len(c or ()) for c in cut)])
            counts = np.r_[0, np.cumsum(n)]
            counts = counts[ends[1:]] - counts[ends[:-1]]
            for k, c in enumerate(cut):
                if c is None:
                    self.whole += 1
                    counts[k] = len(self.enc.library(other[k]))
            out[~simple] = counts
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Token counts of texts, none of them null."""
        from .wordbpe import split_at_spaces

        if not self.enc.by_part:
            return np.array([len(self.enc.library(t)) for t in texts.to_pylist()], np.int64)
        first, coded = split_at_spaces(texts)
        n = self.of_parts(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.empty(0, np.int64)
        total = np.r_[0, np.cumsum(n)]
        return total[first[1:]] - total[first[:-1]]


_COUNTS: dict[tuple, Counts] = worker_cache()


def worker_counts(tokenizer: str, table: tuple[bytes, bytes]) -> Counts:
    """This worker's counts; those of an earlier table go."""
    key = (tokenizer, table)
    if key not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[key] = Counts(tokenizer, table)
    return _COUNTS[key]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    sample_docs: int = 1000,
    sample_chars: int = 4000,
    sample_every: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row, in one narrow pass.

    The first tier is made from the first sample_chars characters of at most sample_docs rows, one in sample_every by
    the hash of their text; the bounds hold the driver's memory and change no result.
    """
    base = coalesced_text(docs, id_col, text_col)
    spread = base.where(F.pmod(F.xxhash64("text"), F.lit(sample_every)) == 0) if sample_every > 1 else base
    sample = [r.t for r in spread.limit(sample_docs).select(F.substring("text", 1, sample_chars).alias("t")).collect()]
    table = base.sparkSession.sparkContext.broadcast(frequent_lengths(sample, tokenizer))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        from .tokencount import worker_counts

        counts = worker_counts(tokenizer, table.value)
        texts = batch.column(1)
        n = [counts.count(texts.slice(lo, hi - lo)) for lo, hi in by_size(texts, TEXT_BYTES)]
        sizes = pc.binary_length(texts).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(np.concatenate(n))], ["doc_id", "n_bytes", "n_tokens"])

    out = map_batches(base, count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
