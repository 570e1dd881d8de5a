"""Audit logs, rejects, metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of an audit record with their defaults.
AUDIT = {
    "source": "unknown", "status": "success", "error": None, "error_category": None, "duration_ms": 0.0, "retries_count": 0, "total_discovered": 0, "filtered_by_validation": 0,
    "filtered_by_freshness": 0, "fresh_jobs": 0, "filtered_by_experience": 0, "eligible_candidates": 0, "deduplicated": 0, "canonical_saved": 0, "updated_existing": 0, "saved_jobs": 0, "saved_internships": 0,
}


def audit_rows(stats: DataFrame, at: Column) -> DataFrame:
    """stats with every field, defaults where missing or null, and the time."""
    value = lambda k, d: (F.coalesce(F.col(k), F.lit(d)) if k in stats.columns and d is not None else F.col(k) if k in stats.columns else F.lit(d).cast("string") if d is None else F.lit(d)).alias(k)
    return stats.select(at.alias("timestamp"), *[value(k, d) for k, d in AUDIT.items()])


def append_audit(stats: DataFrame, at: Column, path: str) -> None:
    audit_rows(stats, at).write.mode("append").json(path)


def tail_audit(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The newest n records, ties by source and number found; lines that do not parse are skipped."""
    kinds = {str: "string", float: "double", int: "long", type(None): "string"}
    schema = "timestamp string, " + ", ".join(f"{k} {kinds[type(d)]}" for k, d in AUDIT.items())
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("timestamp"), F.desc("source"), F.desc("total_discovered")).limit(n)


def exposition(metrics: DataFrame) -> DataFrame:
    """metrics: name, kind, value -> line: a type line before each sample, as text."""
    name = F.regexp_replace(F.lower("name"), "[^a-z0-9_]", "_")
    return metrics.select(F.concat(F.lit("# TYPE "), name, F.lit(" "), "kind", F.lit("\n"), name, F.lit(" "), F.format_string("%.4f", F.col("value"))).alias("line"))


def histograms(rows: DataFrame, key: Column, at: list[str], value: str, n: int = 100) -> DataFrame:
    """key, count, avg_sec, min_sec, max_sec, sum of the last n observations of each key (ties by value). No task sends more than n rows of a key."""
    order = Window.partitionBy("key").orderBy(*[F.desc(c) for c in at], F.desc(value))
    last = rows.select(key.alias("key"), *at, value).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    r = lambda c: F.round(c, 4)
    return last.groupBy("key").agg(F.count("*").alias("count"), r(F.avg(value)).alias("avg_sec"), r(F.min(value)).alias("min_sec"), r(F.max(value)).alias("max_sec"), r(F.sum(value)).alias("sum"))


def histogram_lines(found: DataFrame) -> DataFrame:
    """line: number and sum of each key as text; labels stay behind the name."""
    name, labels = F.regexp_extract("key", r"^[^{]*", 0), F.regexp_extract("key", r"\{.*$", 0)
    line = lambda end, v: F.concat(name, F.lit(end), labels, F.lit(" "), v)
    return found.select(F.explode(F.array(line("_count", F.col("count").cast("string")), line("_sum", F.format_string("%.4f", F.col("sum"))))).alias("line"))


def histogram_json(found: DataFrame) -> DataFrame:
    """key, json: the summary of each key."""
    return found.select("key", F.to_json(F.struct("count", "avg_sec", "min_sec", "max_sec")).alias("json"))


def last_rows(spark: SparkSession, path: str, schema: str, key: Column, at: str, n: int) -> DataFrame:
    """The newest n rows of a history that is appended to, among those that key selects; ties by all columns."""
    rows = spark.read.schema(schema).parquet(path).filter(key)
    return rows.orderBy(F.desc(at), *[F.desc(c) for c in rows.columns if c != at]).limit(n)


def digest(rows: DataFrame, key: str, order: list[Column], line: Column, n: int, id_: str, notified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """digests (key, digest: a list of the best n rows of each key, those notified before left out) and their ids, to be notified now."""
    fresh = rows.join(notified.select(id_).distinct(), id_, "left_anti")
    top = fresh.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__at") <= n)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("__at", line.alias("line")))), lambda s: s["line"])
    return top.groupBy(key).agg(F.concat(F.lit("- "), F.array_join(lines, "\n- ")).alias("digest")), top.select(id_)
