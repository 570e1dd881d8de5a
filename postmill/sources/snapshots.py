"""A stored table of bucketed Parquet files that is replaced bucket by bucket, one manifest at a time.

A snapshot is a manifest: a line of JSON that names the folder of each bucket. A merge reads and rewrites only the buckets
that its rows touch, into a folder of its own, and then renames a new manifest into place under the next number. That
rename is the commit: before it nothing has changed, whatever else was written; two writers of one number can't both have
it, and the later one is told. Readers keep the snapshot they opened, since no file is ever changed.

A manifest also carries marks, names with a number each, and side tables that rows are only appended to (an audit, rejects, what
has been told). All of them change by the same rename, so they can't disagree. A stream marks the batches it has merged, so that a
batch that comes again after a crash changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a file.
FILE_ROWS = 2_000_000


class Conflict(Exception):
    """Another writer has committed since the snapshot was read."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    keys: list[str]
    n_buckets: int
    buckets: dict[str, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)
    sides: dict[str, list[str]] = field(default_factory=dict)


class Store:
    """A table at a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], n_buckets: int = 64) -> Store:
        store = cls(spark, path)
        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
        store._publish(Manifest(0, ", ".join(names), list(keys), n_buckets))
        return store

    def _publish(self, m: Manifest) -> None:
        """Writes the manifest aside and renames it into place; a name that is taken is a conflict."""
        aside, there = self._at(f"staging/{uuid.uuid4().hex}"), self._at(f"manifests/{m.version:012d}.json")
        self._fs.mkdirs(self._at("manifests"))
        self._fs.mkdirs(self._at("staging"))
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        if self._fs.exists(there) or not self._fs.rename(aside, there):
            self._fs.delete(aside, False)
            raise Conflict(f"version {m.version} of {self.path} is there already")

    def versions(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._at("manifests")))
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def manifest(self, version: int | None = None) -> Manifest:
        number = self.versions()[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json").first()[0]
        return Manifest(**json.loads(text))

    def read(self, m: Manifest | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a snapshot, the newest one unless told; of some buckets only, if told."""
        m = m or self.manifest()
        folders = [f"{self.path}/{p}" for b, p in m.buckets.items() if buckets is None or int(b) in buckets]
        schema = _parse_datatype_string(m.schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def side(self, name: str, schema: str, m: Manifest | None = None) -> DataFrame:
        folders = [f"{self.path}/{p}" for p in (m or self.manifest()).sides.get(name, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, m: Manifest):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in m.keys]), F.lit(m.n_buckets)).cast("int")

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], mark: tuple[str, int] | None = None, base: Manifest | None = None, sides: dict[str, DataFrame] | None = None, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Replaces the buckets that keys of new fall into by how(their old rows, new). False if the mark says it was done before.

        new has the keys; how gives rows of the table's schema, in the same buckets. sides: rows to append to side tables. before_commit runs
        between files and rename.
        """
        m = base or self.manifest()
        if mark and m.marks.get(mark[0], -1) >= mark[1]:
            return False
        touched = {r[0] for r in new.select(self.bucket(m)).distinct().collect()}  # n_buckets at most
        marks = m.marks | ({mark[0]: mark[1]} if mark else {})
        buckets = dict(m.buckets)
        if touched:
            columns = [f"`{f.name}`" for f in _parse_datatype_string(m.schema)]
            rows = how(self.read(m, touched), new).select(*columns).withColumn("__bucket", self.bucket(m))
            folder = f"data/{uuid.uuid4().hex}"
            writer = rows.repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS)
            writer.parquet(f"{self.path}/{folder}")
            wrote = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._at(folder)) if "=" in f.getPath().getName()}
            if not wrote <= touched:
                raise ValueError(f"rows for buckets that no key of new falls into: {sorted(wrote - touched)[:5]}")
            buckets = {b: p for b, p in buckets.items() if int(b) not in touched} | {str(b): f"{folder}/__bucket={b}" for b in sorted(wrote)}
        beside = {name: list(paths) for name, paths in m.sides.items()}
        for name, rows in (sides or {}).items():
            beside.setdefault(name, []).append(f"sides/{name}/{uuid.uuid4().hex}")
            rows.write.option("compression", "zstd").parquet(f"{self.path}/{beside[name][-1]}")
        before_commit()
        self._publish(Manifest(m.version + 1, m.schema, m.keys, m.n_buckets, buckets, marks, beside))
        return True
