"""What the training-data operators share: shared folder, tables cut from lineage, shipping of the package."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import note

#: Body of a character class: space and 0x09 to 0x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"


#: Rows of an Arrow batch, where the session has not set them: whole texts travel, and both sides hold a batch.
BATCH_ROWS = 2_000
#: What empties the caches of this package's modules.
CACHES: list[Callable[[], None]] = []


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving memory back at the end of a task: its worker lives on beside those of other stages."""

    def whole_task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            for clear in CACHES:
                clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError, TypeError):  # not every C library has it
                pass

    return whole_task


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without that setting: it gets a temporary folder.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/postmill/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str, level: int = 3) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends, a lost executor costs no recomputation."""
    path = note(shared_dir(df.sparkSession, tag))  # operators.tables.scratch removes it
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so none depends on its own import path, and bounds Arrow batches."""
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, str(BATCH_ROWS))
    if getattr(sc, "_postmill_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="postmill-ship-")) / "postmill_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, os.path.join(top.name, p.relative_to(top)))
    sc.addPyFile(str(path))
    sc._postmill_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(c: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ceil_div(a: float, b: float) -> int:
    return max(1, math.ceil((a or 0) / b))


def volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and characters, for sizing partitions and groups."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    return r["n"] or 0, r["c"] or 0
