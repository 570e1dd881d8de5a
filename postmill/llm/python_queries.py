"""Queries of the operators whose work is done by Python inside tasks."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, jaccard, langid, packing, substrings, tokenfile
from .common import documents


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def codec_of(payload: bytes) -> str:
    """By content, so equal texts have equal media; all three codecs are in use."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def op2_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    heard = audio.read(audio.store(rows, codec_of), audio.features)
    return heard.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", "codec", "feature").alias("feature"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(documents(spark, sf_dir), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.find_and_cut(documents(spark, sf_dir), width=20)
    gone = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", gone.cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def held_out(c: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~held_out()))
    found = langid.predict(docs, model, ["doc_id"], with_spans=False)
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)
    read = tokenfile.read_files(manifest)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_media_audio, op3_jaccard_join, op4_substring_dedup, op9_language_id, op10_token_files)}
SQL = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS ss FROM w),
        s AS (SELECT doc_id, unnest(ss) AS shingle, len(ss) AS n FROM g),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (n + m - c)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x),
        k AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        SELECT g.doc_id, len(ss)::BIGINT AS n_shingles, k.root AS component_id FROM g JOIN k ON g.doc_id = k.node""",
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        o AS (SELECT doc_id, unnest([array_to_string(ws[i : i + 19], ' ') FOR i IN range(1, len(ws) - 18)]) AS k, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
        d AS (SELECT doc_id, i FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        c AS (SELECT DISTINCT doc_id, i + j AS at_word FROM d, (SELECT unnest(range(20)) AS j)),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at_word FROM w),
        v AS (SELECT t.doc_id, t.word, t.at_word, c.doc_id IS NOT NULL AS gone FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.at_word = c.at_word),
        a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY at_word) FILTER (NOT gone) AS kept FROM v GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON w.doc_id = a.doc_id""",
}
