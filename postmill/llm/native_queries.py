"""Queries and SQL of the operators that use DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_chats
from .common import documents
from .exact import mark_copies
from .lines import drop_lines
from .mixing import SEED, SLICE, plan_mix

#: A conversation whose texts hold the template's own control strings.
PROBE = r"\### Assistant: </turn> ok"


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("t"), F.lit("user").alias("r")), F.struct(F.lit(1).alias("t"), F.lit("assistant").alias("r")))).alias("p"))
    probe = probe.select(F.lit(-7).cast("long").alias("conv_id"), F.col("p.t").cast("long").alias("turn"), F.col("p.r").alias("role"), F.lit(PROBE).alias("text"))
    read = read_chats(format_chats(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(documents(spark, sf_dir), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {f.__name__: f for f in (op5_exact_dedup, op6_chat_format, op7_line_dedup, op8_source_mix)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ESC = r"replace(replace(replace({0}, '\', '\e'), '#', '\h'), '<', '\l')"

SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_chat_format": rf"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
        b AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens FROM r)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length({_ESC.format("text")})
                   + CASE WHEN opens THEN 14 + length(replace({_ESC.format("role")}, ':', '\c')) ELSE 7 END)::BIGINT AS formatted_chars
        FROM b GROUP BY conv_id""",
    "op7_line_dedup": f"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
        k AS (SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key AS ckey, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (holder <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN c ON key = ckey GROUP BY doc_id""",
    "op8_source_mix": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0 * source_size::DOUBLE AS cap FROM s),
        v AS (SELECT *, row_number() OVER o AS pos,
                     (1.5 * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                     / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
              FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
        f AS (SELECT arg_min(level, pos) AS free FROM v WHERE level * w <= cap),
        t AS (SELECT source, source_size, least(cap, coalesce(free * w, cap)) AS target,
                     ('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift FROM v, f),
        p AS (SELECT d.*, row_number() OVER (PARTITION BY source
                ORDER BY length(bin(size)), ((doc_id % k) + k) % k, size, doc_id) AS place
              FROM d, (SELECT count(*) // {SLICE} + 1 AS k FROM documents)),
        e AS (SELECT p.*, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each
              FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               size * (floor(each * place + shift) - floor(each * (place - 1) + shift))::BIGINT AS taken FROM e""",
}
