"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals.

1. Documents are dealt into blocks by a hash of their id and text. A block hashes all its windows with one prefix sum (powers of
   an odd base modulo 2**64 over 64-bit word hashes) and keeps the first of equal windows. Hashes go to buckets by
   their top bits, as one row per (block, bucket): eight bytes a window less what the bucket says, and document ids.
2. Spark brings a bucket together; every window there that a smaller (doc_id, start) also has is marked. The answer to
   a block is one bit per window that it sent. A window in a third of all documents is one entry per block.
3. A block meets its answers, marks its own later copies too, merges marked windows into maximal intervals, and cuts.

Texts move once (the exchange of steps 1 and 3 is the same); blocks and buckets hold a set number of characters and
windows, so their number grows with the data and no group does.

Defined cases: a null or empty text has no words and stays empty; a text shorter than a window loses nothing; rows
that share a doc_id are ordered by text; null doc_ids come first, among themselves by block and text; an empty table
gives no rows; other columns are ignored. Two windows count as equal when two independent hashes of theirs, 80 bits in
all, are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, ceil_div, ship, volume

WINDOW = 20
BLOCK_CHARS, BUCKET_WINDOWS = 6_000_000, 400_000
#: Word hashes remembered per worker.
REMEMBERED = 300_000
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SECOND = 0xD6E8FEB86659FD93
SECOND_INVERSE = pow(SECOND, -1, 1 << 64)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()
CACHES.append(_hashes.clear)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each. Arrow splits and finds the distinct words."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    lengths = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    distinct = np.fromiter(map(_hashes.__getitem__, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = distinct[coded.indices.to_numpy(zero_copy_only=False)]
    none = pc.equal(texts, "").to_numpy(zero_copy_only=False)  # an empty text gives one empty word
    return h[~np.repeat(none, lengths)], np.where(none, 0, lengths).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (a bijection)."""
    for by, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(by))) * np.uint64(times)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, width: int, base: int = BASE, inverse: int = BASE_INVERSE) -> np.ndarray:
    """Rabin-Karp hash of h[i : i + width] for every i, by differences of one prefix sum."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    up = np.full(len(h), base, np.uint64)
    up[0] = 1
    up = np.cumprod(up)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    down = np.full(len(h) - width + 1, inverse, np.uint64)
    down[0] = 1
    return mix((total[width:] - total[:-width]) * np.cumprod(down))


def equal_runs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal windows together, those of one kind as they came, and whether each equals the one before it there."""
    order = np.argsort(first, kind="stable")
    same = first[order[1:]] == first[order[:-1]]
    if (same & (second[order[1:]] != second[order[:-1]])).any():  # the first hash alone does not tell them apart
        order = np.lexsort((second, first))
        same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    return order, same


class Block:
    """The documents of one block, in order, with their windows."""

    def __init__(self, table: pa.Table, width: int):
        rows = sorted(zip(table.column("doc_id").to_pylist(), (t or "" for t in table.column("text").to_pylist())), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.doc_ids = [r[0] for r in rows]
        self.texts = [r[1] for r in rows]
        h, self.lengths = word_hashes(pa.array(self.texts, pa.string()))
        ends = np.cumsum(self.lengths)
        hashes, seconds = rolling(h, width), rolling(mix(h), width, SECOND, SECOND_INVERSE).astype(np.uint16)
        # Windows that lie in one document, by their place among the block's words.
        left = np.repeat(ends, self.lengths)[: len(hashes)] - np.arange(len(hashes))
        self.starts = np.flatnonzero(left >= width)
        self.hashes, self.seconds = hashes[self.starts], seconds[self.starts]
        self.docs = np.repeat(np.arange(len(rows)), np.maximum(self.lengths - width + 1, 0))
        order, same = equal_runs(self.hashes, self.seconds)
        self.later = np.zeros(len(order), bool)  # an earlier window of this block has the same words
        self.later[order[1:]] = same
        self.sent = np.flatnonzero(~self.later)

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the windows sent, by bucket and then order; the bucket of each."""
        own = (self.hashes[self.sent] >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(own.astype(np.uint16) if bits <= 16 else own, kind="stable")
        return self.sent[order], own[order]


#: Bytes kept of the first hash, whose other bits are in the bucket's number (eight bits at least), and of both.
TAIL, BOTH = 7, 9


def _pack(first: np.ndarray, second: np.ndarray) -> bytes:
    out = np.empty((len(first), BOTH), np.uint8)
    out[:, :TAIL] = first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TAIL]
    out[:, TAIL:] = second.astype("<u2").view(np.uint8).reshape(-1, 2)
    return out.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(data, np.uint8).reshape(-1, BOTH)
    first = np.zeros((len(rows), 8), np.uint8)
    first[:, :TAIL] = rows[:, :TAIL]
    return first.view("<u8")[:, 0], np.ascontiguousarray(rows[:, TAIL:]).view("<u2")[:, 0]


def find_and_cut(docs: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, n_words, removed (maximal word intervals, array<struct<start,end>>), text (kept words)."""
    import zstandard

    ship(docs.sparkSession)
    _, chars = volume(docs)
    blocks = ceil_div(chars, block_chars)
    bits = max(8, (ceil_div(chars / 6, bucket_windows) - 1).bit_length())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("block", place)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, width)
        index, own = block.buckets(bits)
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, int)
        ids = np.array([d if d is not None else np.iinfo(np.int64).min for d in block.doc_ids], "<i8")
        small = zstandard.ZstdCompressor(level=1)
        out = {"bucket": [], "docs": [], "hashes": []}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            out["bucket"].append(int(own[a]))
            out["docs"].append(small.compress(np.diff(ids[block.docs[index[a:b]]], prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()))
            out["hashes"].append(_pack(block.hashes[index[a:b]], block.seconds[index[a:b]]))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array([key[0].as_py()] * len(out["bucket"]), pa.int32()), "docs": pa.array(out["docs"], pa.binary()), "hashes": pa.array(out["hashes"], pa.binary())})

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        plain = zstandard.ZstdDecompressor()
        hashes = [_unpack(x) for x in table.column("hashes").to_pylist()]
        sizes = [len(x) for x, _ in hashes]
        docs_of = [np.cumsum(np.ascontiguousarray(np.frombuffer(plain.decompress(x), np.uint8).reshape(8, -1).T).view("<i8")[:, 0]) for x in table.column("docs").to_pylist()]
        h, second, d = (np.concatenate(x) for x in (*zip(*hashes), docs_of))
        order, equal = equal_runs(h, second)
        shared = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]
        shared = np.sort(shared)  # by block, then place
        shared = shared[np.lexsort((d[shared], second[shared], h[shared]))]
        first = np.concatenate([[True], (h[shared[1:]] != h[shared[:-1]]) | (second[shared[1:]] != second[shared[:-1]])]) if len(shared) else np.empty(0, bool)
        marked = np.zeros(len(h), bool)
        marked[shared[~first]] = True
        parts = np.split(marked, np.cumsum(sizes)[:-1])
        keep = [i for i, p in enumerate(parts) if p.any()]
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())).combine_chunks(), "bucket": pa.array([key[0].as_py()] * len(keep), pa.int32()), "marks": pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary())})

    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, width)
        index, own = block.buckets(bits)
        marked = block.later.copy()
        # A later window of the block is a copy whether or not its first window is.
        for bucket, marks in zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist()):
            a, b = np.searchsorted(own, [bucket, bucket + 1])
            marked[index[a:b]] = np.unpackbits(np.frombuffer(marks, np.uint8), count=b - a).astype(bool)
        n = int(block.lengths.sum())
        edge = np.zeros(n + 1, np.int32)
        hit = block.starts[marked]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans, kept = [], []
        at = 0
        for text, size in zip(block.texts, block.lengths.tolist()):
            own_gone = gone[at : at + size]
            words = text.encode().split()
            if own_gone.any():
                turns = np.flatnonzero(np.diff(own_gone.astype(np.int8), prepend=0, append=0)).tolist()
                pairs = list(zip(turns[::2], turns[1::2]))
                ends = [0, *(x for p in pairs for x in p), size]
                words = [w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]
                spans.append([{"start": a, "end": b} for a, b in pairs])
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
            at += size
        return pa.table({"doc_id": pa.array(block.doc_ids, pa.int64()), "n_words": pa.array(block.lengths, pa.int64()), "removed": pa.array(spans, spans_type), "text": pa.array(kept, pa.string())})

    sent = rows.groupBy("block").applyInArrow(send, "bucket int, block int, docs binary, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(judge, "block int, bucket int, marks binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, removed array<struct<start:int,end:int>>, text string")
