"""Token ids in files of independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a file (the public seekable zstandard format): data frames, each with the ids of whole consecutive documents
as little-endian unsigned 32-bit numbers; one frame with the document index (ids, validity, token counts, frame
numbers); a skippable frame with the seek table: compressed size, plain size and the low 32 bits of XXH64 of the plain
bytes for every frame. A reader fetches the table and the index, then only the frames of the documents asked for.

Documents are range-partitioned and sorted by doc_id; every partition writes one file under a name that follows from
its number, first under a temporary name, so a task that runs again replaces its own file. Files are reached through
pyarrow's file systems by URI.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first and stays null; rows of one doc_id
go by text and share a file; an empty table gives no files; other columns are ignored. The manifest is a table, and a
file's first position is a prefix sum worked out in Spark.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, materialise, shared_dir, ship, tidy, volume
from .tokens import encoder, slices

#: Fixed values of the format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_BYTES = 1 << 18
CHARS_PER_FILE = 24_000_000
#: Most tasks that read files; each reads several beyond that.
READERS = 20_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.size = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.frames: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.frames.append(len(self.table))
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            self.frame(b"".join(self.pending))
            self.pending, self.size = [], 0

    def frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        self.flush()
        there = np.array([d is not None for d in self.doc_ids], "<u1")
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        self.frame(struct.pack("<Q", len(ids)) + ids.tobytes() + there.tobytes() + np.array(self.lengths, "<i8").tobytes() + np.array(self.frames, "<u4").tobytes())
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUM:
            raise ValueError("no seek table with checksums")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(n - 1)
        (rows,) = struct.unpack_from("<Q", index)
        at = 8
        self.doc_ids = np.frombuffer(index, "<i8", rows, at)
        self.there = np.frombuffer(index, "<u1", rows, at := at + 8 * rows)
        self.lengths = np.frombuffer(index, "<i8", rows, at := at + rows)
        self.frames = np.frombuffer(index, "<u4", rows, at + 8 * rows)

    def frame(self, k: int) -> bytes:
        import xxhash

        self.file.seek(int(self.at[k]))
        plain = self.zstd.decompress(self.file.read(int(self.table[k, 0])))
        if len(plain) != self.table[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, ids) in order; of wanted ids only, if given."""
        starts = np.cumsum(self.lengths) - self.lengths
        pick = np.arange(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)) & (self.there == 1))
        base = {}
        for row, k in reversed(list(enumerate(self.frames))) if len(pick) else ():
            base[k] = starts[row]
        held, plain = -1, b""
        for row in pick:
            k = int(self.frames[row])
            if k != held:
                held, plain = k, self.frame(k)
            at = int(starts[row] - base[k]) * 4
            yield int(self.doc_ids[row]) if self.there[row] else None, int(starts[row]), plain[at : at + 4 * int(self.lengths[row])]


def write_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, files: int) -> DataFrame:
    """Writes the files and returns the manifest, a table: part, path, docs, tokens, start of each file in order."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        system, top = _open(folder)
        name, writer, out, temporary = f"{top}/part-{number:07d}.ids.zst", None, None, None
        for batch in batches:
            if writer is None and batch.num_rows:
                system.create_dir(top)
                temporary = f"{top}/.{uuid.uuid4().hex}.part"
                out = system.open_output_stream(temporary)
                writer = FrameWriter(out)
            for part in slices(batch.column("text")):
                ids = known.batch(batch.column("text")[part.start : part.stop])
                for doc, own in zip(batch.column("doc_id")[part.start : part.stop].to_pylist(), ids):
                    writer.add(doc, own.tobytes() + end)
        if writer is not None:
            writer.close()
            out.close()
            system.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"part": [number], "name": [name.rpartition("/")[2]], "docs": [len(writer.lengths)], "tokens": [int(sum(writer.lengths))]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = materialise(rows.mapInArrow(tidy(run), "part long, name string, docs long, tokens long"), "token-manifest")
    return with_starts(written).select("part", F.concat(F.lit(f"{folder}/"), "name").alias("path"), "docs", "tokens", "start")


def with_starts(files: DataFrame, block: int = 1_000) -> DataFrame:
    """files (part, tokens) with start: tokens of all files before, block by block, so no task orders all of them."""
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("block", F.floor(F.col("part") / block))
    # One row per thousand files meets here.
    blocks = files.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", before(Window.orderBy("block")).alias("first"))
    within = files.withColumn("within", before(Window.partitionBy("block").orderBy("part")))
    return within.join(blocks, "block").withColumn("start", F.col("first") + F.col("within"))


def read_files(manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: all documents, or those of the wanted ids."""
    ship(manifest.sparkSession)
    wanted = None if wanted is None else sorted(set(wanted))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    rows, size = [], 0
                    for doc, start, ids in FrameReader(file).documents(wanted):
                        rows.append((doc, first + start, ids))
                        size += len(ids)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    tasks = max(1, min(READERS, manifest.count()))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(tidy(run), "doc_id long, start long, ids binary")


def write_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, chars_per_file: int = CHARS_PER_FILE) -> DataFrame:
    _, chars = volume(docs)
    return write_files(docs, tokenizer, end_id, shared_dir(docs.sparkSession, "token-files"), ceil_div(chars, chars_per_file))
