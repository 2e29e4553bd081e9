"""Encoders, counts, packing, id files, media and chats against libraries and round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowscout.llm import bytebpe, chat, idstore, isomedia, packing, tokencount
from rowscout.llm.wordbpe import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "Hello, world! It's 12 ½ o'clock.", "it''s don't've 'S", "ÀÉÎ straße ªº µ ÿ", "日本語 テキスト 😀", "İSTANBUL Σας", "a b\u0085c\x1cd", "été", "<|endoftext|> x <|",
    "x" * 5000, "ab " * 3000, "\x00\x01\x7f", "\n\n\t \r\n", "!!!???***$$$ A!! B!!", "aaaa" * 300 + " " + "é" * 700,
]
DOCS = "doc_id long, text string, lang string, DOC_ID string, ids int, start string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark):
    """Null ids and texts, repeated rows, and columns whose names clash."""
    rows = [(i, t, "en", "q", 1, "z") for i, t in enumerate(TEXTS)]
    return table(spark, [*rows, (None, "null id", None, None, None, None), (3, None, None, None, None, None), rows[2]], DOCS)


def test_word_encoder_equals_the_library(library):
    enc = WordEncoder(WORDS, max_words=50)
    assert enc.by_part
    for _ in range(2):
        for t, got in zip(TEXTS, enc.encode(TEXTS), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


ENCODER = WordEncoder(WORDS, max_words=1000)
MIXED = [
    "It’s a test — “quoted”, naïve 😀 price €5 … T̈ ẗ é É K Å ﬁ ǅ ẞ", "中文分词,没有空格的句子。日本語テキスト 한국어 텍스트 가각 ไทย हिन्दी العربية", "ΑΣ ΑΣΑ Σ İi ıI Straße STRASSE x y　z",
    "a​b ́start <|endoftext|>mid <|startoftext|> <| |> don’t DON'T o'clock's ''s", "x_y_z 3.14e-10 ²³ ½ Ⅷ ①②", "Ḁ̣̇ q̣̇",
]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@given(st.text(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_encoder_on_any_latin_text(text):
    assert ids_of(ENCODER.encode([text])[0]) == ENCODER.library(text)


@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(MIXED)), max_size=6).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_word_encoder_on_any_script(text):
    assert ids_of(ENCODER.encode([text])[0]) == ENCODER.library(text)


def test_words_of_any_script_are_looked_up():
    """No text leaves the tables for its script: only parts with a special token's beginning go to the library whole."""
    from rowscout.llm.tokencount import Counts, frequent_lengths

    texts = [f"{a} {b}" for a in MIXED for b in MIXED]
    counts = Counts(WORDS, frequent_lengths(MIXED, WORDS))
    got = [int(n) for _ in range(3) for n in counts.count(pa.array(texts))]
    assert got == 3 * [len(ENCODER.library(t)) for t in texts]
    assert counts.hits >= counts.asked - 3 and counts.misses <= 1 and counts.whole == 3 * 3  # the empty mark is no word
    counts = Counts(WORDS, frequent_lengths([], WORDS))
    assert [int(n) for n in counts.count(pa.array(texts))] == got[: len(texts)]
    first = counts.misses
    assert counts.asked >= first > 80 and [int(n) for n in counts.count(pa.array(texts))] == got[: len(texts)]
    assert counts.misses == first  # the second time the worker's cache has them


BPE = bytebpe.ByteBPE(BYTES, public_tokenizers.PATTERN, max_words=300)


def test_byte_bpe_equals_tiktoken(tik):
    for t, got in zip(TEXTS, BPE.encode(TEXTS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tik.encode_ordinary(t), t[:40]
        assert BPE.decode(got) == t.encode()


@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_matrix_merge_equals_heap_merge(words):
    assert BPE.merge_matrix(words, max(map(len, words))) == [BPE.merge_long(w) for w in words]


def test_byte_bpe_operator(spark, tik):
    docs = clashing(spark)
    enc = bytebpe.encode(docs, BYTES, public_tokenizers.PATTERN)
    rows = bytebpe.decode(enc, BYTES, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id not in (2, 3)}
    for i, t in enumerate(TEXTS):
        if i in by_id:
            assert list(by_id[i].ids) == tik.encode_ordinary(t) and bytes(by_id[i].decoded) == t.encode()
    assert sum(r.doc_id == 3 and not r.ids for r in rows) == 1
    assert bytebpe.encode(docs.where("false"), BYTES, public_tokenizers.PATTERN).count() == 0


def test_token_counts(spark, library):
    docs = clashing(spark)
    rows = tokencount.token_counts(docs, WORDS, limit=100, sample_docs=3, sample_every=1).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id not in (2, 3):
            t = TEXTS[r.doc_id]
            assert (r.n_tokens, r.n_bytes) == (len(library.encode(t, add_special_tokens=False).ids), len(t.encode())) and r.over_limit == (r.n_tokens > 100)
    assert tokencount.token_counts(docs.where("false"), WORDS).count() == 0


def test_first_tier_changes_nothing(spark):
    docs = table(spark, list(enumerate(TEXTS)))
    a, b = (tokencount.token_counts(docs, WORDS, sample_docs=n, sample_every=e).orderBy("doc_id").collect() for n, e in ((1, 1), (16, 4)))
    assert a == b


@given(st.integers(1, 100_000), st.sampled_from([1, 2, 64, 4096]))
def test_cuts(n, longest):
    got, times = (x.tolist() for x in packing.cuts(np.array([n, 1]), longest))
    assert sum(times) == len(got) and got.pop() == 1 and times[0] == len(got)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= longest for x in got) and got == sorted(got, reverse=True)
    assert len([x for x in got if x < longest]) == len({x for x in got if x < longest})


def test_packing(spark, library, tmp_path):
    docs = clashing(spark)
    packed = packing.pack(docs, WORDS, longest=64)
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(r.length == 1 << r.bucket and len(r.ids) == 4 * r.length for r in rows)
    for i, t in enumerate(TEXTS):
        if i in (2, 3):
            continue
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
    assert [r.length for r in rows if r.doc_id == 3 and r.doc_tokens == 1] == [1]
    packing.write_buckets(packed, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == len(rows)
    assert packing.pack(docs.where("false"), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, longest=100)


def test_code_lengths_are_optimal_under_the_limit():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        c = rng.integers(1, 60, 5)
        best = min(sum(a * b for a, b in zip(c, ls, strict=True)) for ls in itertools.product(range(1, 4), repeat=5) if sum(2.0**-x for x in ls) <= 1)
        assert (c * idstore.code_lengths(c, 3)).sum() == best
    assert idstore.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        idstore.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 300_000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.7, 3000) * 3).astype(np.int64)
    counts[:2] = 1, 10**8
    lengths = idstore.code_lengths(counts)
    assert lengths.max() <= idstore.MOST_BITS
    codes, look = idstore.canonical(lengths)
    ids = rng.choice(np.flatnonzero(counts), n).astype(np.uint32)
    payload, offsets, bits = idstore.encode_bits(ids, codes, lengths)
    assert bits == lengths[ids].sum() and len(offsets) == -(-n // idstore.BLOCK)
    assert (idstore.decode_bits(payload, offsets, n, look) == ids).all()
    if n > 5000:  # a block on its own, from its checkpoint
        one = idstore.decode_bits(payload, offsets[1:2], min(idstore.BLOCK, n - idstore.BLOCK), look)
        assert (one == ids[idstore.BLOCK : idstore.BLOCK + len(one)]).all()


def test_id_files(spark, library, tmp_path):
    docs = clashing(spark)
    idstore.write_ids(docs, str(tmp_path / "ids"), WORDS, files=3)
    rows = idstore.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert len(rows) == docs.count() and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and rows[-1].doc_id is None  # without an id comes last
    for r in rows:
        if r.doc_id is not None and r.doc_id not in (2, 3):
            want = np.array([*library.encode(TEXTS[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes()
            assert bytes(r.ids) == want and zlib.crc32(bytes(r.ids)) == zlib.crc32(want)
    same = table(spark, [(7, f"text {i}") for i in range(50)])
    idstore.write_ids(same, str(tmp_path / "same"), WORDS, files=4)
    assert idstore.read_ids(spark, str(tmp_path / "same")).count() == 50
    loose = table(spark, [(None, f"text {i}") for i in range(50)])
    idstore.write_ids(loose, str(tmp_path / "loose"), WORDS, files=4)
    assert idstore.read_ids(spark, str(tmp_path / "loose")).where("doc_id is null").count() == 50
    idstore.write_ids(docs.where("false"), str(tmp_path / "none"), WORDS)
    assert idstore.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_id_files_order_ids_as_integers(spark, tmp_path):
    rng = np.random.default_rng(5)
    ids = [-(1 << 63), (1 << 63) - 1, -1, 0, 1 << 53, (1 << 53) + 1, None, None, *range((1 << 60) - 200, (1 << 60) + 200), *range(-(1 << 60), 90 - (1 << 60))]
    rows = [(i, "word " * int(rng.integers(0, 9))) for i in ids]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    idstore.write_ids(table(spark, rows), str(tmp_path / "wide"), WORDS, files=4)
    got = idstore.read_ids(spark, str(tmp_path / "wide")).orderBy("start").collect()
    known = sorted(i for i in ids if i is not None)
    assert [r.doc_id for r in got] == [*known, None, None]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    dense = table(spark, [(i, "word") for i in range((1 << 60) - 400, (1 << 60) + 400)])
    idstore.write_ids(dense, str(tmp_path / "dense"), WORDS, files=4)
    sizes = [r.n_docs for r in spark.read.parquet(str(tmp_path / "dense" / "files")).collect()]
    assert sum(sizes) == 800 and len(sizes) == 4 and max(sizes) < 300  # the ranges are even however large the ids


@given(st.binary(max_size=30_000))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(text):
    payload = isomedia.pad(text)
    assert len(payload) % 576 == 0 and payload
    data = isomedia.wrap(payload)
    got = isomedia.sample_table(data)
    assert isomedia.sample_bytes(data, got["at"], got["sizes"]) == payload
    assert got["duration"] == got["ticks"] == len(payload) // 576 and np.flatnonzero(got["keys"]).tolist() == list(range(0, len(got["at"]), 12))


def test_media_operator(spark):
    docs = clashing(spark)
    media = isomedia.store(docs)
    rows = isomedia.probe(media, with_payload=True).collect()
    assert len(rows) == docs.count() and all(r.error is None and r.codec == "raw" for r in rows)
    for r in rows:
        if r.doc_id is not None and r.doc_id not in (2, 3):
            assert bytes(r.payload) == isomedia.pad(TEXTS[r.doc_id].encode()) and r.n_bytes == len(TEXTS[r.doc_id].encode())
    good = isomedia.wrap(bytes(576 * 20))
    bad = [None, b"", b"abc", good[:40], good[:-1], good[:300], isomedia.box(b"moov", isomedia.box(b"trak")), b"\0\0\0\4ftyp"]
    rows = isomedia.probe(table(spark, list(enumerate(bad)), "doc_id long, media binary"), with_payload=True).collect()
    assert all(r.error and r.codec is None and r.payload is None for r in rows)


def test_media_boxes_of_other_writers():
    """64-bit sizes, a box to the end, unknown boxes, varying sample sizes and 32-bit offsets."""
    import struct

    sizes = [5, 7, 11]
    body = bytes(range(23))
    for wide in (False, True):
        head = isomedia.box(b"ftyp", b"isom") + isomedia.box(b"free", bytes(9))

        def moov(at, wide=wide):
            table_ = isomedia.full(b"co64", struct.pack(">I2Q", 2, at, at + 12)) if wide else isomedia.full(b"stco", struct.pack(">I2I", 2, at, at + 12))
            stbl = isomedia.box(
                b"stbl", isomedia.full(b"stsd", struct.pack(">I", 1), isomedia.box(b"avc1", bytes(70))), isomedia.full(b"stts", struct.pack(">IIIII", 2, 1, 10, 2, 20)),
                isomedia.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), isomedia.full(b"stsz", struct.pack(">II3I", 0, 3, *sizes)), table_,
            )
            mdhd = isomedia.full(b"mdhd", struct.pack(">QQIQ", 0, 0, 1000, 50) if wide else struct.pack(">IIII", 0, 0, 1000, 50), bytes(4), version=int(wide))
            return isomedia.box(b"moov", isomedia.box(b"trak", isomedia.box(b"mdia", mdhd, isomedia.box(b"minf", stbl))))

        at = len(head) + len(moov(0)) + 8
        got = isomedia.sample_table(head + moov(at) + b"\0\0\0\0mdat" + body)
        assert got["sizes"].tolist() == sizes and got["at"][2] == at + 12
        assert (got["codec"], got["duration"], got["ticks"], got["keys"].sum()) == ("avc1", 50, 50, 3)


def track(number, handler, codec, tables, scale=1000):
    import struct

    stbl = isomedia.box(b"stbl", isomedia.full(b"stsd", struct.pack(">I", 1), isomedia.box(codec, bytes(70))), *tables)
    mdia = isomedia.box(b"mdia", isomedia.full(b"mdhd", struct.pack(">IIII", 0, 0, scale, 0), bytes(4)), isomedia.full(b"hdlr", bytes(4), handler, bytes(13)), isomedia.box(b"minf", stbl))
    return isomedia.box(b"trak", isomedia.full(b"tkhd", struct.pack(">III", 0, 0, number), bytes(68)), mdia)


NO_SAMPLES = [isomedia.full(k, bytes(n)) for k, n in ((b"stts", 4), (b"stsc", 4), (b"stsz", 8), (b"stco", 4))]


def test_media_fragments_and_video_track():
    """A fragmented file of an audio and a video track, with runs of one size and of sizes of their own."""
    import struct

    trex = [isomedia.full(b"trex", struct.pack(">5I", n, 1, 40 // n, 4, 0x10000)) for n in (1, 2)]
    moov = isomedia.box(b"moov", track(1, b"soun", b"mp4a", NO_SAMPLES), track(2, b"vide", b"avc1", NO_SAMPLES, 600), isomedia.box(b"mvex", *trex))
    head = isomedia.box(b"ftyp", b"isom") + moov

    def moof(own):
        audio = isomedia.box(b"traf", isomedia.full(b"tfhd", struct.pack(">I", 1), flags=0x20000), isomedia.full(b"trun", struct.pack(">Ii", 2, own + 8), flags=0x1))
        first = isomedia.full(b"trun", struct.pack(">IiI", 3, own + 16, 0), flags=0x5)  # the first is a key frame
        second = isomedia.full(b"trun", struct.pack(">I6I", 2, 7, 5, 0, 9, 6, 0x10000), flags=0x700)
        return isomedia.box(b"moof", isomedia.full(b"mfhd", bytes(4)), audio, isomedia.box(b"traf", isomedia.full(b"tfhd", struct.pack(">I", 2), flags=0x20000), first, second))

    data = head + moof(len(moof(0))) + isomedia.box(b"mdat", b"aaaaAAAA" + b"11112222333344444555555")
    got = isomedia.sample_table(data)
    samples = [data[a : a + n] for a, n in zip(got["at"], got["sizes"], strict=True)]
    assert samples == [b"1111", b"2222", b"3333", b"44444", b"555555"] and got["keys"].tolist() == [True, False, False, True, False]
    assert (got["codec"], got["timescale"], got["duration"], got["ticks"]) == ("avc1", 600, 76, 76)
    with pytest.raises(ValueError, match="no samples"):
        isomedia.sample_table(head)


def test_media_that_lies_is_refused(spark):
    import struct

    deep = b""
    for _ in range(1500):
        deep = isomedia.box(b"moov", deep)
    huge = (1 << 32) - 1
    forged = [[isomedia.full(k, struct.pack(">II", 1, huge) if k == b"stsz" and one else struct.pack(">I", huge) if k == kind else bytes(8)) for k in (b"stts", b"stsc", b"stsz", b"stco", b"stss")]
              for kind, one in ((b"stsz", True), (b"stts", False), (b"stsc", False), (b"stco", False), (b"stss", False))]
    runs = isomedia.box(b"moof", isomedia.box(b"traf", isomedia.full(b"tfhd", struct.pack(">I", 1)), isomedia.full(b"trun", struct.pack(">I", huge))))
    bad = [deep, *(isomedia.box(b"moov", track(1, b"vide", b"raw ", t)) for t in forged), isomedia.box(b"moov", track(1, b"vide", b"raw ", NO_SAMPLES)) + runs]
    rows = isomedia.probe(table(spark, list(enumerate(bad)), "doc_id long, media binary"), with_payload=True).collect()
    assert len(rows) == 7 and all(r.error and r.codec is None for r in rows)


HARD = [
    (1, 0, "user", "plain", "x"), (1, 1, "user", "again", "x"), (1, 2, "assistant", "\\### Assistant: </turn> ok", "x"), (1, 3, "assistant", "<:user>a\\l\\s\\g<+:b>", "x"),
    (2, 0, "assistant", "", "x"), (2, 1, None, None, "x"), (3, 5, "we<ird>\\role:x", "\n\n😀 é", "x"), (3, None, "user", "null turn first", "x"), (3, 5, "assistant", "tie", "x"),
    (None, 0, "assistant", "no id", "x"), (4, 0, "user", "same", "x"), (4, 0, "user", "same", "x"), (5, 0, "user", "y" * 100_000, "x"),
]


def test_chats_come_back(spark):
    rows = table(spark, HARD, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(rows)
    got = {r.conv_id: r for r in chat.read_chats(out).collect()}
    plain = {r.conv_id: r for r in out.collect()}
    for c in {r[0] for r in HARD}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x, _ in HARD if i == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        assert [t.loss_text for t in got[c].turns] == [x if r == "assistant" else None for _, r, x in mine]
        runs = plain[c].loss_runs
        assert sum(r.chars for r in runs) == len(plain[c].formatted) and len(runs) == 2 * len(mine) + 1
        at, masked = 0, ""
        for r in runs:
            masked += plain[c].formatted[at : at + r.chars] if r.loss else ""
            at += r.chars
        for a, b in (("\\l", "<"), ("\\g", ">"), ("\\s", "\\")):
            masked = masked.replace(a, b)
        assert masked == "".join(x for _, r, x in mine if r == "assistant")
    assert plain[1].formatted.count("<:user>") == 1 and "<+:user>again" in plain[1].formatted  # merged
    assert chat.format_chats(rows.where("false")).count() == 0
    shift = F.transform("loss_runs", lambda r, i: F.struct((r["chars"] + F.when(i == 2, 1).when(i == 3, -1).otherwise(0)).alias("chars"), r["loss"].alias("loss")))
    for wrong in (shift, F.slice("loss_runs", 1, F.size("loss_runs") - 1), F.concat("loss_runs", F.slice("loss_runs", 1, 2))):
        with pytest.raises(Exception, match="does not fit"):
            chat.read_chats(out.where("conv_id = 1").withColumn("loss_runs", wrong)).collect()


def test_chat_plan_is_native(spark):
    rows = table(spark, HARD, "conv_id long, turn long, role string, text string, formatted string")
    plan = chat.read_chats(chat.format_chats(rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_registered_digests(spark, library, tmp_path):
    """The queries' digest columns on a small table, against hashlib and zlib."""
    from rowscout.llm import queries as q

    root = str(tmp_path)
    texts = [t for t in TEXTS if len(t) < 2000]
    table(spark, [*enumerate(texts), (99, None)]).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)}).write.parquet(f"{root}/documents.parquet")
    want = {**dict(enumerate(texts)), 99: ""}
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in want.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in q.op3_byte_bpe(spark, root).collect():
        assert r.decoded_sha256 == sha(want[r.doc_id].encode())
        assert r.ids_sha256 == sha(" ".join(map(str, np.frombuffer(BPE.encode([want[r.doc_id]])[0], "<u4").tolist())).encode())
    for r in q.op4_iso_media(spark, root).collect():
        body = isomedia.pad(want[r.doc_id].encode())
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) == (sha(body), len(body), zlib.crc32(body[-32:]))
        assert (r.media_sha256, r.media_bytes) == (sha(isomedia.wrap(body)), len(isomedia.wrap(body)))
    start = 0
    for r in q.op6_token_files(spark, root).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens
    for r in q.op1_packing(spark, root).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
