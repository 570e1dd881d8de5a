"""Packing of documents into sequences: first-fit decreasing with a tournament tree, within randomised groups.

A document's ids (with an end id) are cut at multiples of the sequence length. Pieces are dealt by a hash into groups
of about ``group`` pieces (equal pieces of a task are numbered, so that repeated rows part too); each group is packed alone: pieces by falling length, each into the first bin with room,
which a tournament tree over the bins' free room finds in logarithmic time. Groups are independent, so packing needs
one shuffle and no task ever holds more than a group.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; a null
doc_id is kept as null; a document of any length is cut, never shortened; ties in length go by doc_id, start and ids;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, ship, tidy, volume
from .tokens import encoder, slices

LENGTH, GROUP = 1024, 4096


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """sizes, falling: the bin of each and its offset there. The tree's leaves are bins; inner nodes hold the most free room below."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * width)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:  # the left contest has no bin with room
                node += 1
        bins[i], offsets[i] = node - width, room - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), turn (of equal rows of a task): each id lies in exactly one piece."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("turn", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = encoder(tokenizer), np.array([end_id], "<u4")
        seen: dict[int, int] = {}  # rows alike can swap their turns, so a task that runs again deals the same pieces
        for batch in batches:
            for part in slices(batch.column("text")):
                ids = known.batch(batch.column("text")[part.start : part.stop])
                rows = []
                for doc, own in zip(batch.column("doc_id")[part.start : part.stop].to_pylist(), ids):
                    own = np.concatenate([own, last])
                    alike = hash((doc, own.tobytes()))
                    turn = seen[alike] = seen.get(alike, -1) + 1
                    rows += [(doc, s, min(length, len(own) - s), len(own), own[s : s + length].tobytes(), turn) for s in range(0, len(own), length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, start long, length long, doc_tokens long, ids binary, turn int")


def pack(pieces: DataFrame, groups: int, length: int = LENGTH, seed: int = 1) -> DataFrame:
    """pieces with sequence_id and offset; sequence ids are unique, offsets within a sequence have no gap."""
    ship(pieces.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["ids"].map(hash_of), rows["start"], rows["doc_id"].fillna(-1), -rows["length"]))
        rows = rows.iloc[order]
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.drop(columns=["part", "turn"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids", "turn"), F.lit(groups)).alias("part")
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    return pieces.select("*", part).groupBy("part").applyInPandas(run, schema)


def hash_of(ids: bytes) -> int:
    import zlib

    return zlib.crc32(ids)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    n, chars = volume(docs)
    groups = ceil_div(n + chars / (3 * length), group)
    return pack(cut_pieces(docs, tokenizer, end_id, length), groups, length)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, used, ids (binary): the pieces of each sequence joined; padded to length unless used is a power of two."""
    ship(packed.sparkSession)

    def join(offsets: pd.Series, parts: pd.Series) -> bytes:
        ids = b"".join(p for _, p in sorted(zip(offsets, parts)))
        used = len(ids) // 4
        return ids if used & (used - 1) == 0 else ids + np.full(length - used, pad_id, "<u4").tobytes()

    @F.pandas_udf("binary")
    def padded(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ps: join([p["offset"] for p in ps], [p["ids"] for p in ps]))

    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return parts.select("sequence_id", "used", padded("parts").alias("ids"))
