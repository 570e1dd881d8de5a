"""Structured Streaming over event files: windows, first sightings, drained tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_folder


def event_stream(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    """Events of Parquet files as a stream with ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, keys: list[str], every: str, late: str) -> DataFrame:
    """Tumbling windows; what is later than the watermark is dropped."""
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_sightings(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all there is now and gives the table it wrote. Table and checkpoint are in the shared folder."""
    spark = rows.sparkSession
    top = f"{shared_folder(spark)}/postmill/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{top}/out/all" if mode == "complete" else f"{top}/out/*")
    return out


def due(last: Column, every_minutes: int, now: Column) -> Column:
    """A schedule that never ran is not due: its first sight starts the clock."""
    return F.coalesce(last + F.make_dt_interval(mins=F.lit(every_minutes)) <= now, F.lit(False))
