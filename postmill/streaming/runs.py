"""Logs of runs and approvals as keyed state over event files, in event-time windows.

A key's events wait in its state until the watermark has passed the end of its window, so their order of arrival does not
matter; then the key is settled in the order of the events and its state goes. What comes after its window was given out
is not heard. State holds one window's events of a key, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that end a run.
TERMINAL = ("completed", "failed", "cancelled")


def run_log(events: list[tuple]) -> tuple:
    """(n_events, status, ended_at) of a run's events (at in microseconds, id, kind) in order: its log ends with the first terminal status."""
    n = 0
    for at, _, kind in events:
        n += 1
        if kind in TERMINAL:
            return n, kind, at
    return n, "running", None


def approvals(events: list[tuple], hours: int) -> tuple:
    """(asked, suppressed, approved, rejected, expired, pending, unheard): a request while one is pending is suppressed; one that nobody
    answered within the hours expires; an answer without a pending request is unheard. Events: (at, id, kind), in order.
    """
    asked = suppressed = approved = rejected = expired = unheard = 0
    since = None
    for at, _, kind in events:
        if since is not None and at > since + hours * 3_600_000_000:
            since, expired = None, expired + 1
        if kind == "request":
            if since is None:
                since, asked = at, asked + 1
            else:
                suppressed += 1
        elif kind in ("approve", "reject"):
            if since is None:
                unheard += 1
            else:
                since, approved, rejected = None, approved + (kind == "approve"), rejected + (kind == "reject")
    return asked, suppressed, approved, rejected, expired, int(since is not None), unheard


def settled(events: DataFrame, keys: list[str], late: str, settle: Callable[[list[tuple]], tuple], schema: str, day: int = 1) -> DataFrame:
    """A row per key once the watermark has passed its end. events: as windowed gives them for as many days; schema: of the keys and what settle gives.

    Spark's windowed aggregate holds the lists, so no key's state goes through Python one by one; settle runs over Arrow batches of keys that are done.
    """
    held = F.sort_array(F.collect_list(F.struct(F.col("micros").alias("at"), "id", "kind"))).alias("events")
    spans = events.withWatermark("at", late).groupBy(F.window("at", f"{day} days").alias("span"), *[k for k in keys if k != "window"]).agg(held)
    done = spans.select(*[F.col("span.start").alias("window") if k == "window" else k for k in keys], "events")
    columns = [tuple(c.split()) for c in schema.split(", ")]
    names, kinds = [c for c, _ in columns], [{"long": pa.int64(), "string": pa.string()}[k] for _, k in columns[len(keys) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("events")
            flat, edges = lists.flatten(), [0, *np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()]
            every = list(zip(*(flat.field(c).to_pylist() for c in ("at", "id", "kind"))))
            told = [settle(every[a:b]) for a, b in zip(edges, edges[1:])]
            values = [pa.array(v, t) for v, t in zip(zip(*told) if told else [()] * (len(names) - len(keys)), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *values], names=names)

    return done.mapInArrow(run, schema)


def windowed(events: DataFrame, at: str, id_: str, kind: Column, keys: list[Column]) -> DataFrame:
    """events by keys: keys, at, micros (of at), id, kind. settled puts them into windows, once the watermark is known."""
    return events.select(*keys, F.col(at).alias("at"), F.unix_micros(at).alias("micros"), F.col(id_).alias("id"), kind.alias("kind"))


def drain_state(rows: DataFrame, path: str) -> DataFrame:
    """Runs the stream over all there is now, from its checkpoint if it has one, and gives the table it wrote."""
    spark = rows.sparkSession
    provider, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        rows.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        if was is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, was)
    return spark.read.schema(rows.schema).parquet(f"{path}/out/*")
