"""Packing by power-of-two decomposition.

The ids of a document are cut into pieces whose lengths are powers of two: as many of the greatest length as fit, then
the binary digits of what is left, longest first. Every piece is a sequence of its own, so no sequence crosses
documents and none is padded; sequences of equal length form a bucket, and a training batch is drawn from one bucket.

Cases: a null text counts as empty, which still has its end id and so one piece of length one. Equal documents, and
repeated or null document ids, are packed row by row like any others. Other columns are ignored. A text of any length
gives as many pieces as it needs. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import TEXT_BYTES, by_size, coalesced_text

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"
PIECES = 50_000  # rows of a batch


def cuts(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the pieces of documents of n ids each, longest first, document by document, and how many pieces
    each has; lengths are powers of two and sum to n."""
    sizes = longest >> np.arange(longest.bit_length())
    times = n[:, None] // sizes & 1  # the binary digits below the longest
    times[:, 0] = n // longest
    return np.repeat(np.tile(sizes, len(n)), times.ravel()), times.sum(axis=1)


def pack(
    docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), bucket (log2 of the
    length), sequence_id and offset in that sequence (always 0, as a sequence holds one piece).

    A narrow pass: nothing is shuffled. sequence_id is unique; it depends on the partition and place of the row, so
    write the result once where ids must stay.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordbpe import encoder, slices_of, with_end

        enc = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi in by_size(texts, TEXT_BYTES):
                ids, first = with_end(*enc.encode_array(texts.slice(lo, hi - lo)), end_id)
                n = np.diff(first)
                size, times = cuts(n, longest)
                at = np.r_[0, np.cumsum(size)]
                doc = np.repeat(np.arange(len(n)), times)
                for a in range(0, len(size), PIECES):
                    b = min(a + PIECES, len(size))
                    d = doc[a:b]
                    cols = [keys.take(pa.array(lo + d)), *(pa.array(x) for x in (at[a:b] - first[d], size[a:b], n[d]))]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, slices_of(ids[at[a] : at[b]], at[a : b + 1] - at[a])], ["doc_id", "start", "length", "doc_tokens", "ids"]
                    )

    return coalesced_text(docs, id_col, text_col).mapInArrow(pieces, SCHEMA).select(
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        "ids",
        F.round(F.log2("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences to one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
