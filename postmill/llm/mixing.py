"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Each document of a source expects target / source_size copies. Documents stand in a fixed order within their source;
expected copies are prefix-summed along it, one random offset per source is added, and a document is emitted once per
integer boundary that its interval crosses. The order goes by size class, then by a slice of doc_id, then by size, so
the words taken come near the target and no source is ever ordered by one task: counts per (source, class, slice) and
per block of slices give each slice its starting rank, and only rows of one slice are numbered together.

Defined cases: a null text has size 0; sources go by code point, null last; a source of size 0 has target 0; weights
repeat along the sources; targets stop at ``most`` times the source's size and the excess goes to the others by
weight; null doc_ids are sliced by size and text; equal (size, doc_id) rows may swap copies among themselves, of which
they are given the same number in total; an empty table gives no rows; other columns, of any name, are kept by ``mix``
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CLASS, materialise, whole

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: About so many documents are numbered together, and so many slices are a block.
SLICE, BLOCK = 2_000, 1_000


def n_words(text: Column) -> Column:
    t = F.btrim(text, F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WHITE_CLASS + "+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """source, source_size, target, shift: one row per source. sizes: source, source_size."""
    # One row per source: these windows order sources, not documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    want = share * F.sum(F.col("source_size").cast("double")).over(all_rows)
    left = want - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).withColumn("at", F.row_number().over(order))
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))).over(all_rows)["level"]
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(free * F.col("w"), F.col("cap"))))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return s.select("source", "source_size", "target", shift.alias("shift"))


def starts(cells: DataFrame) -> DataFrame:
    """cells (source, class, slice, rows) with start: rows of the source in cells before, block by block."""
    cells = cells.withColumn("block", F.floor(F.col("slice") / BLOCK))
    blocks = cells.groupBy("source", "class", "block").agg(F.sum("rows").alias("rows"))
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("first", before(Window.partitionBy("source").orderBy("class", "block"))).select(*[F.col(c).alias(f"b_{c}") for c in ("source", "class", "block", "first")])
    cells = cells.withColumn("within", before(Window.partitionBy("source", "class", "block").orderBy("slice")))
    on = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")) & (F.col("block") == F.col("b_block"))
    return cells.join(blocks, on).select("source", "class", "slice", (F.col("b_first") + F.col("within")).alias("start"))


def copies(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """sized (doc_id, source, size, text_key, ...) with source_size, target, copies."""
    n = sized.count()
    slices = n // SLICE + 1
    t = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, seed)
    slice_ = F.coalesce(F.pmod("doc_id", F.lit(slices)), F.pmod(F.xxhash64("size", "text_key"), F.lit(slices)))
    rows = sized.withColumn("class", F.length(F.bin("size"))).withColumn("slice", slice_)
    cells = starts(rows.groupBy("source", "class", "slice").agg(F.count("*").alias("rows"))).select(*[F.col(c).alias(f"c_{c}") for c in ("source", "class", "slice", "start")])
    cells = cells.join(t.select(F.col("source").alias("t_source"), "source_size", "target", "shift"), F.col("c_source").eqNullSafe(F.col("t_source")))
    within = Window.partitionBy("source", "class", "slice").orderBy("size", "doc_id")
    rows = rows.withColumn("place", F.row_number().over(within))
    on = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")) & (F.col("slice") == F.col("c_slice"))
    out = rows.join(cells, on).withColumn("place", F.col("place") + F.col("c_start"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(each * F.col("place") + F.col("shift")) - F.floor(each * (F.col("place") - 1) + F.col("shift"))
    return out.withColumn("copies", crossed.cast("long")).select(*sized.columns, "source_size", "target", "copies")


def sizes(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", "source", n_words(whole()).alias("size"), F.xxhash64(whole()).alias("text_key")), "mix-sizes")


def plan_mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, text_key, source_size, target, copies: one row per document."""
    return copies(sizes(docs), **how)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document's row as many times as it is taken, columns as they came. Texts move once."""
    taken = copies(sizes(docs), **how).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("total"), F.count("*").alias("alike")).filter("total > 0")
    taken = materialise(taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("text_key").alias("key"), "total", "alike"), "mix-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(whole()).alias("own"))
    rows = rows.join(taken, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("key")))
    each = F.col("total").cast("int")
    if not taken.filter("alike > 1").isEmpty():  # rows alike in id, source and text share their copies in turn
        turn = F.row_number().over(Window.partitionBy("id", "of", "own").orderBy(F.lit(0)))
        each = F.floor((F.col("total") + F.col("alike") - turn) / F.col("alike")).cast("int")
    rows = rows.withColumn("each", each).filter("each > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("each")))).select("row.*")
