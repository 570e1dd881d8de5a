"""Filter interaction audit: what each filter of a chain removes by itself, beside the others and in every order.

1. Every row is judged by every filter in one pass of expressions over whole texts, and written as its flags.
2. Per part of the corpus and filter, the ids of failing rows are a sorted posting list, cut into ranges of ids. A range holds
   a set number of rows whatever the size of the part, and lists are kept apart by label class (good, toxic), so that sizes
   alone answer questions about labels.
3. In each range, unions of lists are merged and differences taken by galloping: a run of one list up to the next id of
   another is found by doubling steps and a binary search, and taken whole. What leaves a range is, for each filter and set of
   earlier filters, the size of the difference; sizes are summed in Spark.
4. Every order of the filters reads those sums: a step removes what its filter fails less what earlier filters removed.

Ids in the lists are row numbers, so that rows which share a doc_id count as rows. Their high bits are the partition that
wrote the row, so a range is a run of rows as they lie on disk.

Defined cases: a null text is empty; a null part is the empty string; labels count as set if any label row of the doc_id has
them; null doc_ids have no labels, and are neither copies nor originals; rows that share a doc_id and a text are no copies of each
other; a part without any failing row has rows of zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialise, ship, whole

#: Bits of a row number within a range: 2**14 rows.
RANGE_BITS = 14
CLASSES = 4


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * (len(WHITE) - 1)), " "), "")


def firsts(rows: DataFrame) -> DataFrame:
    """text_sha, first: texts that several doc_ids have, with the smallest of these. rows: text_sha, doc_id."""
    return rows.groupBy("text_sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("text_sha", "first")


def quality_filters() -> dict[str, Column]:
    """The five filters as failure conditions on text, n_words, n_distinct, doc_id and first."""
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * capitals > 3 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
        "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    }


def flags(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, doc_id, good, toxic and one boolean per filter: every row of docs."""
    text = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole().alias("text"))
    sized = text.withColumn("words", words(F.col("text")))
    sized = sized.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words")), "text_sha": F.unhex(F.sha2(F.col("text").cast("binary"), 256))})
    own = {k: v for k, v in quality_filters().items() if k != "E"}
    judged = materialise(sized.select("doc_id", "part", "text_sha", *[v.alias(k) for k, v in own.items()]), "audit-judged")
    repeated = materialise(firsts(judged), "audit-copies")
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = judged.join(repeated, "text_sha", "left").withColumn("E", quality_filters()["E"]).join(told, "doc_id", "left")
    no = F.lit(False)
    return rows.select("part", "doc_id", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), *quality_filters())


def gallop(ids: list[int], least: int, at: int) -> int:
    """The first place from at on whose id is least or more, by doubling steps."""
    step, n = 1, len(ids)
    while at + step < n and ids[at + step] < least:
        at, step = at + step, step * 2
    return bisect_left(ids, least, at, min(n, at + step + 1))


def merged(a: list[int], b: list[int]) -> list[int]:
    """Union of two sorted lists, in runs."""
    out: list[int] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            k = gallop(a, b[j], i)
            out += a[i:k]
            i = k
        else:
            k = gallop(b, a[i], j)
            out += b[j:k]
            j = k
    return out + a[i:] + b[j:]


def beyond(a: list[int], b: list[int]) -> int:
    """How many ids of a are not in b."""
    n = i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            k = gallop(a, b[j], i)
            n += k - i
            i = k
        else:
            j = gallop(b, a[i], j)
    return n + len(a) - i


def differences(lists: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """filter, set of others as a mask, and how many ids the filter has beyond their union."""
    unions = {0: []}
    for mask in range(1, 1 << len(lists)):
        low = mask & -mask
        unions[mask] = merged(unions[mask ^ low], lists[low.bit_length() - 1])
    for f, own in enumerate(lists):
        for mask, others in unions.items():
            if own and not mask >> f & 1:
                yield f, mask, beyond(own, others)


def sizes(flagged: DataFrame, names: list[str]) -> DataFrame:
    """part, filter, prior (mask of other filters), n, n_good, n_toxic: rows that fail the filter and none of prior. Zeros are left out."""
    numbered = materialise(flagged.withColumn("rid", F.monotonically_increasing_id()), "audit-flags")
    class_ = F.col("good").cast("int") + 2 * F.col("toxic").cast("int")
    fails = F.array_compact(F.array(*[F.when(F.col(n), F.lit(i)) for i, n in enumerate(names)]))
    postings = numbered.select("part", F.shiftright("rid", RANGE_BITS).alias("range"), class_.alias("class"), "rid", F.explode(fails).alias("filter"))
    lists = postings.groupBy("part", "range", "class", "filter").agg(F.sort_array(F.collect_list("rid")).alias("ids"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        part, _, class_ = (k.as_py() for k in key)
        held = dict(zip(table.column("filter").to_pylist(), table.column("ids").to_pylist()))
        found = [d for d in differences([held.get(i, []) for i in range(len(names))]) if d[2]]
        columns = [[part] * len(found), [class_] * len(found), *([d[i] for d in found] for i in range(3))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "class", "filter", "prior", "n"])

    ship(flagged.sparkSession)
    found = lists.groupBy("part", "range", "class").applyInArrow(compare, "part string, class int, filter int, prior int, n long")
    of = lambda bit: F.sum(F.when(F.col("class").bitwiseAND(F.lit(bit)) > 0, F.col("n")).otherwise(0))
    return found.groupBy("part", "filter", "prior").agg(F.sum("n").alias("n"), of(1).alias("n_good"), of(2).alias("n_toxic"))


def orders(names: list[str]) -> list[tuple[str, int, int, int]]:
    """filter_order, step, filter and the mask of filters before it."""
    out = []
    for p in permutations(range(len(names))):
        for k, f in enumerate(p):
            out.append(("".join(names[i] for i in p), k + 1, f, sum(1 << i for i in p[:k])))
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: every part, order and step."""
    spark, names = docs.sparkSession, list(quality_filters())
    flagged = materialise(flags(docs, labels, part), "audit-rows")
    totals = flagged.groupBy("part").agg(F.count("*").alias("total"))
    cells = [(f, sum(1 << i for i in rest)) for f in range(len(names)) for k in range(len(names)) for rest in combinations([i for i in range(len(names)) if i != f], k)]
    grid = totals.select("part", "total", F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(m).alias("prior")) for f, m in cells])).alias("c")).select("part", "total", "c.*")
    counts = ["n", "n_good", "n_toxic"]
    full = grid.join(sizes(flagged, names), ["part", "filter", "prior"], "left").select("part", "total", "filter", "prior", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    own = Window.partitionBy("part", "filter")  # 16 rows
    full = full.withColumns({"alone": F.max("n").over(own), "unique_fails": F.min("n").over(own)})
    plan = spark.createDataFrame(orders(names), "filter_order string, step int, filter int, prior int")
    steps = materialise(full, "audit-sizes").join(F.broadcast(plan), ["filter", "prior"])  # 600 rows for five filters
    done = F.sum("n").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - done).alias("kept"), F.col("n").alias("removed"), (F.col("alone") - F.col("n")).alias("redundant"), "unique_fails",
        F.col("n_good").alias("good_lost"), F.col("n_toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
