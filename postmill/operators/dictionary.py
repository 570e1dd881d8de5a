"""Names of a dictionary in free text, by a join: texts become runs of words with their places, and meet an alias table of any size.

No alias stands in a plan or on the driver; a text is read once. Of names that overlap the leftmost stands, and of those that
begin at one word the longest. Only names that overlap in a chain need to be settled one after another: a window over a text's
matches cuts it where no match reaches across, and each piece is folded by itself.

Defined cases: names and texts are compared by their words in lower case, whatever stands between; an alias of several values
takes the least; null and empty texts and aliases match nothing; rows are told apart by their key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: anything but blanks and the marks that part a list.
WORD = r"([^\s,;:/|()\[\]{}]+)"
#: Words of the longest alias.
MOST_WORDS = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def alias_table(aliases: DataFrame, alias: str, value: str) -> DataFrame:
    """run, n (words), value: one row per distinct run of words."""
    rows = aliases.select(words(F.col(alias)).alias("w"), F.col(value).alias("value")).filter((F.size("w") > 0) & (F.size("w") <= MOST_WORDS))
    return rows.select(F.array_join("w", " ").alias("run"), F.size("w").alias("n"), "value").groupBy("run", "n").agg(F.min("value").alias("value"))


def longest_matches(rows: DataFrame, key: str, text: str, aliases: DataFrame, alias: str = "alias", value: str = "value") -> DataFrame:
    """key, first (word, from 0), n (words), run, value: the names in each text, in the order of their places when sorted by first."""
    known = alias_table(aliases, alias, value)
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # MOST_WORDS at most
    if not lengths:
        lengths = [1]
    runs = lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: i + n <= F.size("w")), lambda i: F.struct(i.alias("first"), F.array_join(F.slice("w", i + 1, n), " ").alias("run")))
    split = rows.select(F.col(key), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    every = split.select(key, F.explode(F.concat(*[runs(n) for n in lengths])).alias("r")).select(key, "r.first", "r.run")
    met = every.join(known, "run").select(key, "first", "n", "run", "value")
    order = Window.partitionBy(key).orderBy("first", F.desc("n"))
    reach = F.max(F.col("first") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    piece = F.sum(F.when(F.col("first") < F.coalesce(reach, F.lit(0)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    m = F.struct("first", (-F.col("n")).alias("less"), "n", "run", "value")
    pieces = met.withColumn("piece", piece).groupBy(key, "piece").agg(F.sort_array(F.collect_list(m)).alias("m"))
    none = F.struct(F.lit(0).alias("end"), F.filter("m", lambda x: F.lit(False)).alias("kept"))
    step = lambda s, x: F.when(x["first"] >= s["end"], F.struct((x["first"] + x["n"]).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    kept = F.when(F.size("m") == 1, F.col("m")).otherwise(F.aggregate("m", none, step)["kept"])
    return pieces.select(key, F.explode(kept).alias("k")).select(key, "k.first", "k.n", "k.run", "k.value")
