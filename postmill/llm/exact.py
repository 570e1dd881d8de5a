"""Exact dedup by content-defined chunk recipes, in DataFrame expressions only.

A text is cut where its own content says so: at the first sentence or line end after MIN characters, or at MAX
characters. Chunks are reduced to identifiers (64-bit hashes); one pass over the distinct chunks verifies that
every identifier stands for one content, and an identifier that does not gets an ordinal per content. Two texts
are equal exactly when their ordered identifier lists are, so only lists are compared and shuffled from there on.
Groups come from two partial aggregations, and only lists that occur twice are joined back to the rows, from a table of
their own: a join of two plain shuffles, which adaptive execution may split where a list is frequent.

Defined cases: a null text is the empty text (an empty recipe); rows are documents; a null doc_id ranks below every
other; of rows with equal text and equal largest doc_id one stays (smallest lang, source, nulls first where present);
an empty table gives no rows; extra columns are ignored by ``mark_copies`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole

MIN, MAX = 256, 2048


def chunk_pattern(least: int = MIN, most: int = MAX) -> str:
    """Matches consecutive chunks that cover the whole text."""
    return f"(?s).{{{least},{most}}}?(?:[.!?]\\s|\\n)|.{{1,{most + 2}}}"


def chunks(text: Column, least: int = MIN, most: int = MAX) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def identifier(chunk: Column, bits: int = 64) -> Column:
    """bits below 64 make collisions likely; tests use that."""
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def _ordinals(pairs: DataFrame) -> DataFrame | None:
    """(h, chunk, k) for contents whose identifier is shared with another content; None if there are none."""
    distinct = pairs.distinct()
    twice = materialise(distinct.groupBy("h").count().filter("count > 1").select("h"), "chunk-collisions")
    if twice.isEmpty():
        return None
    w = Window.partitionBy("h").orderBy("chunk")
    return materialise(distinct.join(twice, "h", "left_semi").withColumn("k", F.row_number().over(w)), "chunk-ordinals")


def recipes(docs: DataFrame, least: int = MIN, most: int = MAX, bits: int = 64) -> DataFrame:
    """doc_id, tie (lang and source where present), rid (unique), recipe array<struct<h,k>>, text_sha256."""
    tie = F.struct(*[F.col(c).cast("string").alias(c) for c in ("lang", "source") if c in docs.columns] or [F.lit(0).alias("none")])
    base = docs.select("doc_id", tie.alias("tie"), whole().alias("text"))
    parts = chunks(F.col("text"), least, most)
    pairs = base.select(F.explode(parts).alias("chunk")).select(identifier(F.col("chunk"), bits).alias("h"), "chunk")
    clash = _ordinals(pairs)
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    if clash is None:
        lists = F.transform(parts, lambda c: F.struct(identifier(c, bits).alias("h"), F.lit(0).alias("k")))
        return base.select("doc_id", "tie", F.monotonically_increasing_id().alias("rid"), lists.alias("recipe"), sha)
    rows = materialise(base.withColumn("rid", F.monotonically_increasing_id()), "chunk-rows")
    found = (
        rows.select("rid", F.posexplode(parts).alias("pos", "chunk"))
        .withColumn("h", identifier(F.col("chunk"), bits))
        .join(clash, ["h", "chunk"], "left")
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("h", F.coalesce("k", F.lit(0)).alias("k")).alias("id")))).alias("ids"))
    )
    empty = F.array().cast("array<struct<h:bigint,k:int>>")
    return rows.join(found, "rid", "left").select("doc_id", "tie", "rid", F.coalesce(F.transform("ids", lambda x: x["id"]), empty).alias("recipe"), sha)


def mark_copies(docs: DataFrame, least: int = MIN, most: int = MAX, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    lists = materialise(recipes(docs, least, most, bits), "recipes")
    by_id = lists.groupBy("recipe", "doc_id").agg(F.min(F.struct("tie", "rid")).alias("first"), F.count("*").alias("n"))
    groups = by_id.groupBy("recipe").agg(F.max(F.struct("doc_id", "first.rid")).alias("keep"), F.sum("n").alias("group_size")).filter("group_size > 1")
    several = materialise(groups.select(F.col("recipe").alias("of"), "keep", "group_size"), "copy-groups")
    out = lists.join(several, F.col("recipe") == F.col("of"), "left")
    keep_id = F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    kept = F.col("keep").isNull() | (F.col("rid") == F.col("keep.rid"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without rows whose text another row keeps; columns as they came. Texts move once."""
    marked = materialise(mark_copies(docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])), "marked-copies")
    kept = marked.filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.sha2(whole().cast("binary"), 256).alias("own"))
    rows = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")), "left_semi")
    again = marked.groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    again = materialise(again, "repeated-copies")
    if not again.isEmpty():  # one row of those with equal doc_id and text stays
        on = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha"))
        ties = [F.col(f"row.{c}").cast("string") for c in ("lang", "source") if c in docs.columns] or [F.lit(0)]
        twice = rows.join(again, on, "left_semi").groupBy("row.doc_id", "own").agg(F.min_by("row", F.struct(*ties)).alias("row"))
        rows = rows.join(again, on, "left_anti").select("row").unionByName(twice.select("row"))
    return rows.select("row.*")
