"""Tables written to the folder that driver and executors share, to end lineage, and a scope that removes them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders made within each open scope, the innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; only a local master may go without it."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def note(path: str) -> str:
    """path, to be removed with the innermost scope."""
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, on leaving, the tables that were written within to end lineage. Write or collect results inside; a frame that reads such a table is of no use after."""
    _scopes.append([])
    try:
        yield
    finally:
        paths = spark._jvm.org.apache.hadoop.fs.Path
        for path in _scopes.pop():
            at = paths(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: How much larger than its compressed files a table is taken to be, as rows of a hash table.
INFLATION = "20"


def expect_inflation(spark: SparkSession) -> None:
    """Sizes of files decide what is broadcast before anything runs. Sorted numbers shrink twentyfold in a file, so ten MB of it would fill
    a driver. A factor that was set is left alone; tables that are small as rows are still broadcast, since adaptive execution sees their rows.
    """
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) == 1.0:
        spark.conf.set(factor, INFLATION)


def cut_lineage(df: DataFrame) -> DataFrame:
    expect_inflation(df.sparkSession)
    path = note(f"{shared_folder(df.sparkSession)}/postmill/tables/{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
