"""What needs rows before or after: runs, sliding counts, stop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_count(rows: DataFrame, key: str, ts: str, seconds: int) -> Column:
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return F.count("*").over(w)


def until_stale_run(rows: DataFrame, key: str, order: list[str], stale: Column, run: int = 4) -> DataFrame:
    """Rows of each key up to the one that completes the first run of so many stale ones."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__stale", stale.cast("int")).withColumn("__part", F.sum(1 - F.col("__stale")).over(w))
    streak = F.sum("__stale").over(Window.partitionBy(key, "__part").orderBy(*order))
    marked = marked.withColumn("__done", (streak >= run).cast("int"))
    before = F.coalesce(F.sum("__done").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__before", before).filter("__before = 0").drop("__stale", "__part", "__done", "__before")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Number of the session of each row: a new one after a gap."""
    w = Window.partitionBy(key).orderBy(ts)
    since = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    opens = F.when(since.isNull() | (since > gap_seconds * 1_000_000), 1).otherwise(0)
    return rows.withColumn("__opens", opens).withColumn("session", F.sum("__opens").over(w)).drop("__opens")


def since_last(rows: DataFrame, key: str, order: list[str], ends: Column) -> DataFrame:
    """rows with part: rows of a key up to and with one that ends its part, and at: the place within it."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part", before)
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)))


def streaks(rows: DataFrame, key: str, order: list[str], bad: Column, least: int) -> DataFrame:
    """key, streaks (runs of at least so many bad rows) and longest."""
    marked = rows.withColumn("__bad", F.coalesce(bad, F.lit(False)).cast("int"))
    marked = marked.withColumn("__run", F.sum(1 - F.col("__bad")).over(Window.partitionBy(key).orderBy(*order)))
    runs = marked.groupBy(key, "__run").agg(F.sum("__bad").alias("n"))
    return runs.groupBy(key).agg(F.count_if(F.col("n") >= least).alias("streaks"), F.max("n").alias("longest"))


def run_state(rows: DataFrame, key: str, order: str, state: Column, metric: str) -> DataFrame:
    """key, state, events, total: the first final state of a run stays, and what comes after it does not count."""
    marked = rows.select(key, F.col(order).alias("__at"), state.alias("__state"), F.col(metric).alias("__metric"))
    end = marked.groupBy(key).agg(F.min(F.when(F.col("__state").isNotNull(), F.struct("__at", "__state"))).alias("__end"))
    counted = marked.join(end, key).filter(F.col("__end").isNull() | (F.col("__at") <= F.col("__end.__at")))
    return counted.groupBy(key).agg(F.coalesce(F.max("__end.__state"), F.lit("running")).alias("state"), F.count("*").alias("events"), F.sum("__metric").alias("total"))
