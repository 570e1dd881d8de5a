"""Queries and SQL of decontamination, the Merkle manifest and the filter audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, interactions, merkle
from .common import documents


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    number = F.col("n_chars").cast("decimal(20,0)")
    found = merkle.manifest(docs, {"n_chars": F.when(tampered, number + 1).otherwise(number)})
    text = lambda c: F.lower(F.hex(c))
    siblings = F.transform(F.filter("proof", lambda s: F.length(s) > 1), lambda s: text(F.substring(s, 2, merkle.DIGEST)))
    return found.select(
        F.col("id").alias("doc_id"),
        *[text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        text(F.col("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op11_decontamination, op12_merkle_manifest, op13_filter_audit)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 of a decimal number: a byte is xored in, then eight bits are shifted out.
_CRC = "xor(list_reduce(flatten([[4294967295::BIGINT], flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _climb(table: str) -> str:
    """One more level of a table (lang, lv, idx, node): pairs, or a last one alone."""
    ahead = "PARTITION BY lang ORDER BY idx"
    return f"SELECT lang, lv + 1, idx // 2, sha256(node || coalesce(nxt, '')) FROM (SELECT *, lead(node) OVER ({ahead}) AS nxt, count(*) OVER (PARTITION BY lang) AS n FROM {table}) WHERE n > 1 AND idx % 2 = 0"


def _proof(tree: str, path: str) -> str:
    """Siblings of every place of a path (key, lang, lv, idx)."""
    return f"SELECT p.key, p.lv, p.idx, s.node AS sib FROM {path} p LEFT JOIN {tree} s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lv = p.lv AND s.idx = xor(p.idx, 1)"


SQL = {
    "op11_decontamination": f"""
        WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
        p AS (SELECT DISTINCT item, least(len(ws), 10) AS k, unnest([array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') FOR i IN range(1, greatest(len(ws) - 8, 2))]) AS win FROM b WHERE len(ws) > 0),
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        n AS (SELECT DISTINCT k FROM p),
        o AS (SELECT doc_id, k, unnest([array_to_string(ws[i : i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS win, unnest(range(1, len(ws) - k + 2)) AS i FROM d, n WHERE len(ws) >= k),
        m AS (SELECT o.doc_id, o.i, o.k, p.item FROM o JOIN p ON o.k = p.k AND o.win = p.win),
        h AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at_word FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE f AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS told FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM f),
        t(lang, lv, idx, node) AS (SELECT lang, 0, place, leaf FROM l UNION ALL {_climb("t")}),
        s AS (SELECT lang, arg_max(node, lv) AS subroot, max(lv) AS height FROM t GROUP BY lang),
        r AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM s),
        u(lang, lv, idx, node) AS (SELECT '', 0, place, subroot FROM r UNION ALL {_climb("u")}),
        w AS (SELECT arg_max(node, lv) AS root, max(lv) AS height FROM u),
        a AS (SELECT l.doc_id, l.lang, l.leaf, l.told, l.place, r.place AS top, r.subroot, r.height AS low, w.root, w.height AS high, row_number() OVER () AS key
              FROM l JOIN r ON l.lang IS NOT DISTINCT FROM r.lang, w),
        x AS (SELECT key, lang, lv, place >> lv::BIGINT AS idx FROM (SELECT *, unnest(range(low))::INT AS lv FROM a)),
        y AS (SELECT key, '' AS lang, lv, top >> lv::BIGINT AS idx, low FROM (SELECT *, unnest(range(high))::INT AS lv FROM a)),
        z AS ({_proof("t", "x")} UNION ALL SELECT key, a.low + lv, idx, sib FROM ({_proof("u", "y")}) JOIN a USING (key)),
        q AS (SELECT key, sha256(coalesce(string_agg(sib, '' ORDER BY lv), '')) AS proof FROM z GROUP BY key),
        v(key, lv, acc) AS (SELECT key, 0, told FROM a UNION ALL
             SELECT v.key, v.lv + 1, sha256(CASE WHEN z.idx % 2 = 1 THEN z.sib || v.acc ELSE v.acc || coalesce(z.sib, '') END) FROM v JOIN z ON v.key = z.key AND v.lv = z.lv),
        e AS (SELECT key, arg_max(acc, lv) AS folded FROM v GROUP BY key)
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM a JOIN e USING (key) LEFT JOIN q USING (key)""",
    "op13_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        m AS (SELECT text AS same, min(doc_id) AS first FROM w GROUP BY text),
        b AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
                     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, coalesce(w.doc_id > first, false) AS E
              FROM w JOIN m ON text = same LEFT JOIN b ON w.doc_id = b.doc_id),
        g AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY 1, 2),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT a.l || b.l || c1.l || d.l || e.l AS filter_order, [a.bit, b.bit, c1.bit, d.bit, e.bit] AS bits FROM c a, c b, c c1, c d, c e WHERE a.bit | b.bit | c1.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS own, bits FROM o),
        k AS (SELECT filter_order, step, own, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS prior FROM s),
        r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | prior) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & prior = 0) AS removed,
                     sum(n) FILTER (mask & own > 0 AND mask & prior > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
                     sum(n_good) FILTER (mask & own > 0 AND mask & prior = 0) AS good_lost, sum(n_toxic) FILTER (mask & own > 0 AND mask & prior = 0) AS toxic_lost
              FROM g, k GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r""",
}
