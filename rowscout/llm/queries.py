"""The registered queries of this package: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, chat, idstore, isomedia, packing, quality, simhash, suffixes, tokencount, vectors
from .frames import read, shared_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), WORDS)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bytebpe.encode(read(spark, sf_dir, "documents"), BYTES, public_tokenizers.PATTERN)
    back = bytebpe.decode(encoded, BYTES, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = isomedia.probe(isomedia.store(read(spark, sf_dir, "documents")), with_payload=True)
    keys = F.transform("key_ranges", lambda x: F.concat_ws("+", x["offset"], x["length"]))
    return read_back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", "codec", "timescale", "duration", "n_samples", F.size("key_ranges"), F.crc32(F.encode(F.array_join(keys, ","), "utf-8"))
        ).alias("feature"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    idstore.write_ids(read(spark, sf_dir, "documents"), path, WORDS)
    return idstore.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("t")
    )
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    both = chat.read_chats(chat.format_chats(rows))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss_text"].isNotNull()), lambda t: t["loss_text"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return both.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_repeats(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), WORDS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_embedding_near_dedup,
        op3_byte_bpe,
        op4_iso_media,
        op5_quality,
        op6_token_files,
        op7_simhash,
        op8_chat,
        op9_suffix_dedup,
        op10_token_counts,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL = {
    "op2_embedding_near_dedup": """
        with recursive v as (select vec_id, embedding::double[] as e from embeddings),
        links as (
            select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.9
        ),
        reach as (select vec_id as x, vec_id as y from v union select r.x, l.y from reach r join links l on r.y = l.x),
        least as (select x, min(y) as component_id from reach group by x),
        n as (select x, count(*) as c from links group by x)
        select vec_id, coalesce(c, 0)::bigint as n_links, component_id, vec_id = component_id as kept
        from v join least on vec_id = least.x left join n on vec_id = n.x
    """,
    "op8_chat": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all
            select -7, i, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) t(i, r)
        ),
        e as (
            select *, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') as er,
                replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') as et,
                lag(role) over w as before, lead(role) over w as after,
                row_number() over w as i
            from rows window w as (partition by conv_id order by turn nulls first, role, text)
        )
        select conv_id, count(*)::bigint as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
            sum(3 + length(er) + length(et) + (before is not distinct from role)::int
                + case when after is not distinct from role then 0 else 8 end)::bigint as formatted_chars
        from e group by conv_id
    """,
    "op9_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        starts as (
            select doc_id, s, substr(h, 2 * s + 1, 100) as g
            from (select doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) as s from d)
        ),
        owned as (select doc_id, s, min(doc_id) over (partition by g) as o from starts),
        hits as (select distinct doc_id, s from owned where o < doc_id),
        runs as (
            select doc_id, s, sum(new) over (partition by doc_id order by s) as r
            from (
                select doc_id, s, (s > coalesce(lag(s) over (partition by doc_id order by s) + 50, -1))::int as new from hits
            )
        ),
        spans as (select doc_id, r, min(s) as a, max(s) + 50 as b from runs group by doc_id, r),
        gaps as (
            select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from spans
            union all
            select d.doc_id, coalesce(x.b, 0), length(h) // 2
            from d left join (select doc_id, max(b) as b from spans group by doc_id) x on x.doc_id = d.doc_id
        ),
        kept as (
            select d.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as k
            from gaps join d on d.doc_id = gaps.doc_id group by d.doc_id
        ),
        counts as (select doc_id, sum(b - a) as removed, count(*) as n from spans group by doc_id)
        select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed,
            coalesce(n, 0)::bigint as n_spans, sha256(unhex(k)) as kept_sha256
        from d join kept on kept.doc_id = d.doc_id left join counts on counts.doc_id = d.doc_id
    """,
}
