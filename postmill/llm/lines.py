"""Line dedup in DataFrame expressions only.

A table holds the 128-bit hashes of the normalised lines of every document, worked out once. Exploded, distinct within
a row, they count documents per hash; hashes found in enough documents are a table of their own, which meets the exploded
(position, hash) again in an equi-join of two plain shuffles that Spark may split where a line is frequent. A document
then gets the positions it loses and is reassembled from its own lines by the positions that stay: texts move once, and
the work is linear in a document's lines.

Defined cases: a null or empty text is one empty line; rows that share a doc_id count as one document, and every row of
a null doc_id as one; a null doc_id never holds a line
for the others and keeps its lines only if all holders are null; rows that share the largest doc_id all keep theirs;
rows of equal doc_id and text are treated alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, lower_ascii, materialise, whole


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _hash(line: Column, least: int) -> Column:
    """Null for a line too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= least, F.unhex(F.md5(key.cast("binary"))))


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (what stays)."""
    # Rows are told apart by doc_id and a hash of the text: equal ones lose the same positions.
    base = docs.select("doc_id", F.xxhash64(whole()).alias("key"), F.split(whole(), "\n", -1).alias("lines"))
    hashed = materialise(base.select("doc_id", "key", F.transform("lines", lambda x: _hash(x, min_chars)).alias("hashes")), "line-hashes")
    seen = hashed.select("doc_id", F.explode(F.array_compact(F.array_distinct("hashes"))).alias("h"))
    ids = hashed.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("doc_id IS NOT NULL AND n > 1").isEmpty():  # then rows are documents
        seen = seen.withColumn("n", F.lit(1))
    else:
        seen = seen.groupBy("h", "doc_id").agg(F.when(F.col("doc_id").isNull(), F.count("*")).otherwise(1).alias("n"))
    common = seen.groupBy("h").agg(F.sum("n").alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= min_docs)
    common = materialise(common.select("h", "holder"), "common-lines")
    places = hashed.select("doc_id", "key", F.posexplode("hashes").alias("pos", "h")).filter("h IS NOT NULL")
    lost = places.join(common, "h").filter(~F.col("doc_id").eqNullSafe(F.col("holder"))).groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(F.collect_set("pos").alias("lost"))
    out = base.join(lost, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left")
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost"), lambda i: F.get("lines", i))
    out = out.withColumn("stay", F.when(F.col("lost").isNull(), F.col("lines")).otherwise(stays))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("text"))
