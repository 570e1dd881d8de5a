"""Ingestion of raw postings as a stream: reject, gate, merge, audit and tell, all by one commit per batch.

A batch is raw postings of several sources. A source that failed gave rows with an error and nothing else; its failure is
classified and touches no other source. Valid and fresh postings are brought to one key (the job's hash, or the hash of a
stored posting with the same URL) and merged into a stored table; rejects, the audit of each source and the ids told for the
first time are side tables of the same store. The manifest's mark names the last batch, so a batch that comes again after
a crash, at whatever point, changes nothing.

Defined cases: rows that share a hash share the smallest of their URLs, and hashes that share that URL are one posting; of rows of one posting
the newest counts (undated last); a stored posting keeps its salary where it has one, its date only advances, and it becomes
active; a source whose rows are all errors is ``blocked`` if one of them is a block, else ``failed``; an empty batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import latest_of
from ..operators.tables import cut_lineage
from ..sources.boards import classify_error
from ..sources.snapshots import Store

RAW = ["job_hash", "source", "source_url", "title", "company_name", "salary_max", "posted_at", "error", "status_code"]
JOBS = "job_hash string, source string, source_url string, title string, company_name string, salary_max double, posted_at timestamp_ntz, is_active boolean, first_batch long, last_batch long"
REPORT = (
    "batch long, source string, status string, error_category string, discovered long, filtered_by_validation long, filtered_by_freshness long, deduplicated long, canonical_saved long, updated_existing long"
)
REJECTS, TOLD = "batch long, source string, source_url string, reason string", "batch long, job_hash string"


def create(spark, path: str, n_buckets: int = 64) -> Store:
    return Store.create(spark, path, spark.createDataFrame([], JOBS).schema, ["job_hash"], n_buckets)


def to_one_key(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """fresh with key: the hash under which a posting is, or will be, stored."""
    urls = fresh.groupBy("job_hash").agg(F.min("source_url").alias("url"))
    first = urls.groupBy("url").agg(F.min("job_hash").alias("first"))
    by_url = stored.groupBy(F.col("source_url").alias("url")).agg(F.min("job_hash").alias("by_url"))
    known = stored.select("job_hash", F.lit(True).alias("known"))
    keys = urls.join(first, "url").join(by_url, "url", "left").join(known, "job_hash", "left")
    return fresh.join(keys.select("job_hash", F.when(F.col("known"), F.col("job_hash")).otherwise(F.coalesce("by_url", "first")).alias("key")), "job_hash")


def ingest(store: Store, raw: DataFrame, batch: int, oldest: Column, valid: Column, name: str = "ingest", before_commit: Callable[[], None] = lambda: None) -> bool:
    """Merges one batch; False if it was merged before. raw: RAW; oldest: the gate's time; valid: null or why a row is refused."""
    m = store.manifest()
    if m.marks.get(name, -1) >= batch:
        return False
    number = F.lit(batch).cast("long").alias("batch")
    rows = cut_lineage(raw.select(*RAW, F.when(F.col("error").isNull(), valid).alias("reason")))
    good = rows.filter("error IS NULL AND reason IS NULL")
    fresh = good.filter(F.col("posted_at") >= oldest)
    keyed = cut_lineage(to_one_key(fresh, store.read(m).select("job_hash", "source_url")))
    newest = latest_of(keyed.select(F.col("key").alias("job_hash"), "source", "source_url", "title", "company_name", "salary_max", "posted_at"), ["job_hash"], "posted_at")
    known = store.read(m).select("job_hash", F.lit(True).alias("known"))
    newest = cut_lineage(newest.join(known, "job_hash", "left").withColumn("known", F.coalesce("known", F.lit(False))))

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("was", F.struct(*old.columns)).select("job_hash", "was").join(new.withColumn("now", F.struct(*new.columns)).select("job_hash", "now"), "job_hash", "full_outer")
        was, now = (lambda c: F.col(f"was.{c}")), (lambda c: F.col(f"now.{c}"))
        later = lambda c: F.when(F.col("now").isNotNull(), F.coalesce(now(c), was(c))).otherwise(was(c)).alias(c)
        return both.select(
            "job_hash", *[F.coalesce(was(c), now(c)).alias(c) for c in ("source", "source_url")], later("title"), later("company_name"), F.coalesce(was("salary_max"), now("salary_max")).alias("salary_max"),
            F.greatest(was("posted_at"), now("posted_at")).alias("posted_at"), (F.coalesce(was("is_active"), F.lit(False)) | F.col("now").isNotNull()).alias("is_active"),
            F.coalesce(was("first_batch"), F.lit(batch)).cast("long").alias("first_batch"), F.when(F.col("now").isNotNull(), F.lit(batch)).otherwise(was("last_batch")).cast("long").alias("last_batch"),
        )

    sides = {
        "report": report(rows, good, fresh, newest, oldest).select(number, "*"),
        "rejects": rows.filter("reason IS NOT NULL").select(number, "source", "source_url", "reason"),
        "told": newest.filter("NOT known").select(number, "job_hash"),
    }
    return store.merge(newest.drop("known"), merged, mark=(name, batch), base=m, sides=sides, before_commit=before_commit)


def report(rows: DataFrame, good: DataFrame, fresh: DataFrame, newest: DataFrame, oldest: Column) -> DataFrame:
    """One row per source of the batch."""
    error = classify_error(F.col("error"), F.col("status_code"))
    failed = F.col("error").isNotNull()
    old = ~F.coalesce(F.col("posted_at") >= oldest, F.lit(False))
    sources = rows.groupBy("source").agg(
        F.bool_and(failed).alias("none"), F.max(F.when(failed, error["category"] == "rate_limit_block")).alias("block"), F.min(F.when(failed, error["category"])).alias("error_category"),
        F.count_if(~failed).alias("discovered"), F.count_if(F.col("reason").isNotNull()).alias("filtered_by_validation"), F.count_if(~failed & F.col("reason").isNull() & old).alias("filtered_by_freshness"),
        F.count_if(~failed & F.col("reason").isNull() & ~old).alias("fresh"),
    )
    # A posting counts for the source of its newest row.
    kept = newest.groupBy("source").agg(F.count("*").alias("kept"), F.count_if("known").alias("updated_existing"))
    both = sources.join(kept, sources["source"].eqNullSafe(kept["source"]), "left").drop(kept["source"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    status = F.when(~F.col("none"), "success").when(F.col("block"), "blocked").otherwise("failed").alias("status")
    category = F.when(F.col("none") & F.col("block"), "rate_limit_block").when(F.col("none"), F.col("error_category")).alias("error_category")
    return both.select("source", status, category, *[zero(c) for c in ("discovered", "filtered_by_validation", "filtered_by_freshness")], (F.col("fresh") - F.coalesce("kept", F.lit(0))).cast("long").alias("deduplicated"),
                       (F.coalesce("kept", F.lit(0)) - F.coalesce("updated_existing", F.lit(0))).cast("long").alias("canonical_saved"), zero("updated_existing"))


def overall(reports: DataFrame) -> DataFrame:
    """batch, status over its sources: all alike, or partly a success, or failed."""
    is_ = lambda s: F.col("status") == s
    status = F.when(F.bool_and(is_("success")), "success").when(F.bool_and(is_("blocked")), "blocked").when(F.bool_or(is_("success")), "partial_success").otherwise("failed")
    return reports.groupBy("batch").agg(status.alias("status"))


def run(rows: DataFrame, store: Store, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], oldest: Column, valid: Column, name: str = "ingest", before_commit: Callable[[int], None] = lambda n: None, after_commit: Callable[[int], None] = lambda n: None) -> None:
    """Runs the stream over all there is. prepare brings a batch of it to RAW. The two hooks run within each batch, around its commit."""

    def one(batch: DataFrame, number: int) -> None:
        ingest(store, prepare(batch), number, oldest, valid, name, lambda: before_commit(number))
        after_commit(number)

    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
