"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, run over every text once.

Texts and items are normalised alike, as UTF-8 bytes: A-Z become a-z, every other ASCII character that is no digit becomes a
blank, words stay as they are. The automaton reads " w1 w2 ... wn "; a match ends at the blank behind a window's last word,
so it tells words, and words tell bytes and characters of the original.

Items of equal words are one, which bounds nothing but saves much; the items' words travel in a broadcast of at most
BROADCAST_BYTES, and an automaton holds at most AUTOMATON_BYTES of windows. Beyond the second, a task runs several automata
over each lot of texts it has read, one at a time; beyond the first, the table is written and read again once per
broadcast. In both cases hits add up, so the result is the same at every size.

Defined cases: null, empty and wordless texts have no words and no hits; items without words have no window; an item of fewer
words than the width is one window; rows of one item_id count as one item; an item without an id marks words, and is in no
list; an empty table of items leaves every document clean; an empty table of documents gives no rows; columns of docs come
back in one struct, so no name clashes; equal rows are answered alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, ceil_div, lower_ascii, materialise, ship, tidy, whole

WIDTH = 10
#: Bytes of items in a broadcast, of windows in an automaton, of text in a lot.
BROADCAST_BYTES, AUTOMATON_BYTES, LOT_BYTES = 16_000_000, 4_000_000, 24_000_000
#: Bytes to lower-case letters, digits, themselves (0x80 and above) or a blank.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def normalised(text: Column) -> Column:
    """Words of a text, joined by one blank."""
    return F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, " "))


class Automata:
    """The windows of some items, dealt out to automata of a bounded size; one is kept at a time."""

    def __init__(self, items: list[tuple[bytes, list]], width: int, most: int):
        self.items, self.width = items, width
        self.parts: list[list[int]] = [[]]
        size = 0
        for i, (text, _) in enumerate(items):
            if size and size + len(text) * width > most:
                self.parts.append([])
                size = 0
            self.parts[-1].append(i)
            size += len(text) * width
        self.held: tuple = (None, None, None)

    def part(self, k: int) -> tuple:
        """The automaton over windows, and of each window its number of words and its items."""
        if self.held[0] != k:
            import ahocorasick

            self.held = (None, None, None)
            windows: dict[bytes, set[int]] = {}
            for i in self.parts[k]:
                words = self.items[i][0].split()
                for a in range(max(1, len(words) - self.width + 1)):
                    windows.setdefault(b" ".join(words[a : a + self.width]), set()).add(i)
            machine, known = ahocorasick.Automaton(), []
            for w, of in windows.items():
                machine.add_word(f" {w.decode('latin-1')} ", len(known))
                known.append((w.count(b" ") + 1, of))
            if known:
                machine.make_automaton()
            self.held = (k, machine if known else None, known)
        return self.held[1:]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list]]:
        """Of each text its number of words, the hit words as (first, end) in order, and the ids of items found, sorted."""
        plain = [b" " + b" ".join(words_of(t)) + b" " for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set[int]] = [set() for _ in texts]
        for k in range(len(self.parts)):
            machine, known = self.part(k)
            if machine is None:
                continue
            for i, line in enumerate(plain):
                hits = list(machine.iter(line.decode("latin-1")))
                if hits:
                    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    last = np.searchsorted(blanks, [end for end, _ in hits]).tolist()
                    spans[i] += [(word - known[w][0], word) for word, (_, w) in zip(last, hits)]
                    for w in {w for _, w in hits}:
                        found[i] |= known[w][1]
        return [(line.count(b" ") - 1 if len(line) > 2 else 0, union(s), sorted({x for i in f for x in self.items[i][1]})) for line, s, f in zip(plain, spans, found)]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_text(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Characters of the original from the first to the last word of each interval of words."""
    if not spans:
        return []
    raw = text.encode()
    inside = np.frombuffer(raw.translate(PLAIN), np.uint8) != 32
    turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = turns[::2], turns[1::2]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[starts[a]]), int(before[ends[b - 1]])) for a, b in spans]


_built: dict = {}
CACHES.append(_built.clear)
SPANS = "array<struct<first:int,end:int,from_char:int,to_char:int>>"


def item_texts(items: DataFrame) -> DataFrame:
    """words (normalised, joined), ids: one row per distinct sequence of words."""
    rows = items.select(F.col("item_id").cast("string").alias("id"), normalised(F.col("text")).alias("words")).filter("words <> ''")
    return materialise(rows.groupBy("words").agg(F.sort_array(F.collect_set("id")).alias("ids")), "bench-items")


def scan(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """row (the columns of docs), n_words, spans (hit words as [first, end), with their characters in the text), item_ids (sorted as strings).

    docs: text; items: item_id, text.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = item_texts(items)
    total = texts.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length(F.array_join("ids", ",")), F.lit(0)))).first()[0]
    rounds = ceil_div(total, broadcast_bytes / 2)
    turn = F.pmod(F.xxhash64("words"), F.lit(rounds))
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0).alias("n_words"), F.array().cast(SPANS).alias("spans"), none.alias("item_ids"))
    for k in range(rounds):
        told = spark.sparkContext.broadcast([(r.words.encode(), r.ids) for r in (texts if rounds == 1 else texts.filter(turn == k)).toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], told=told, key=k) -> Iterator[pa.RecordBatch]:
            if key not in _built:
                _built.clear()
                _built[key] = Automata(told.value, width, automaton_bytes)
            for batch in batches:
                column = batch.column("row").field("text")
                at = 0
                while at < batch.num_rows:  # lots of a bounded size, so results do not wait for a whole batch
                    n = size = 0
                    while at + n < batch.num_rows and (not n or size < LOT_BYTES):
                        size += len(column[at + n].as_py() or "")
                        n += 1
                    yield lot(_built[key], batch.slice(at, n), column.slice(at, n).to_pylist())
                    at += n

        rows = rows.mapInArrow(tidy(run), rows.schema)
        if rounds > 1:
            rows = materialise(rows, "bench-round")
    return rows


def lot(automata: Automata, batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    n_words, spans, ids = [], [], []
    for text, was, had, (n, hit, found) in zip(texts, batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), automata.scan(texts)):
        hit = union([(s["first"], s["end"]) for s in was] + hit)
        n_words.append(n)
        spans.append([{"first": a, "end": b, "from_char": x, "to_char": y} for (a, b), (x, y) in zip(hit, in_text(text or "", hit))])
        ids.append(sorted({*had, *found}))
    fields = batch.schema
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int32()), pa.array(spans, fields.field("spans").type), pa.array(ids, fields.field("item_ids").type)], schema=fields)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def cut(text: Column, spans: Column) -> Column:
    """The text without the characters of the spans, the words around each parted by one blank."""
    edges = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["to_char"]))
    ends = F.concat(F.transform(spans, lambda s: s["from_char"]), F.array(F.length(text)))
    parts = F.zip_with(edges, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p != ""), " "))
