"""Exact n-gram Jaccard join with adaptive multi-match prefixes, to components.

Texts become sets of 64-bit shingle hashes; equal sets are one class. All sets are ordered by one global order: rough
document frequency (a count sketch of fixed size over all documents, which may only misplace tokens, never lose a
pair), then hash. In that order two sets that overlap enough share l tokens within their prefixes of
size - least overlap + l, for every l. Each class picks the l that costs least: tokens to scan in the lists of its
longer prefix against candidates to verify, both from exact list lengths. A pair is verified only if it shares
as many prefix tokens as the smaller l of the two demands, and if two bounds allow enough overlap: tokens before a
shared one that are in no other prefix can't be common to the two, and the parity sketches of two sets differ in no
more bits than the sets do in tokens. Both bounds are exact. A sketch has as many bits as the set has tokens, or up to
twice that; whole it meets the pairs that are left, and in the second step, folded to a few words, the list entries too.

Components need not see all pairs of a group. First every list offers its members to one anchor, its class with the
most shared tokens; verified links join classes into components. Then only pairs across components remain, counted
whole, and are verified in the same way, whatever their number: no link between components is lost.

Verification brings each set to its partner's task once: pairs are dealt by their first class, of which a large group
is split, and the documents read again are only those that stand for a class in some pair.

Defined cases: null or empty text, or one without words: size 0, linked with nothing; a text with fewer words than a
shingle is one shingle; repeated rows and equal texts share a class; a null doc_id takes part and never names a
component unless all its members are null; an empty table gives no rows; other columns are ignored. Shingles and
classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, tidy
from .components import components
from .substrings import rolling, word_hashes
from .tokens import slices

#: Counters of the frequency sketch: 4 MB of ranks when broadcast, whatever the input.
COUNTERS = 1 << 22
CHUNK = 1 << 16
#: Sketches of so many tasks are added by one group at a time.
ADDED = 64
#: Words of 64 bits of the sketch that goes with the list entries of the second step.
SKETCH = 8
#: Bytes of text whose sets are held at a time.
SLICE = 3_000_000
#: Longest multi-match, and the cost of verifying a candidate against that of one list entry.
LONGEST, VERIFY = 6, 8.0
#: Bits of the filter that spares unneeded sets a shuffle: half a megabyte; false hits only cost time.
FILTER_BITS = 1 << 22
#: Members of one class's pairs that are verified together.
MEMBERS = 64


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every text."""
    h, lengths = word_hashes(texts, lower=True)
    windows = rolling(h, k)
    ends = np.cumsum(lengths)
    out = []
    for n, end in zip(lengths.tolist(), ends.tolist()):
        if 0 < n < k:
            few = np.full(k, 0x5851F42D4C957F2D + n, np.uint64)
            few[:n] = h[end - n : end]
            own = rolling(few, k)
        else:
            own = np.sort(windows[end - n : max(end - n, end - k + 1)])
        out.append(own if len(own) < 2 else own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def batched_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for part in slices(texts, SLICE):
        yield from shingle_sets(texts[part.start : part.stop], k)


def _class_id(tokens: np.ndarray) -> int | None:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)) if len(tokens) else None


def least_overlap(n, m, percent: int):
    """Tokens that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per counter, over all documents; COUNTERS numbers. Tasks' counts are added in levels, ADDED at a time."""
    import zstandard

    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(COUNTERS, np.uint32), [], 0

        def settle() -> None:
            nonlocal held, size
            at, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, int), 0)
            total[at] += np.asarray(n, np.uint32)
            held, size = [], 0

        for batch in batches:
            for t in batched_sets(batch.column("text"), k):
                held.append((t & np.uint64(COUNTERS - 1)).astype(np.int32))
                size += len(t)
                if size > 1_000_000:
                    settle()
        settle()
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(total[a : a + CHUNK].tobytes()) for a in range(0, COUNTERS, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "part", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        plain, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        total = np.zeros(CHUNK, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(plain.decompress(c.as_py()), np.uint32)
        packed = pack.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([packed], pa.binary())})

    kind = "chunk int, part int, counts binary"
    rows = docs.select("text").mapInArrow(tidy(count), kind)
    for _ in range(3):  # enough for ADDED ** 3 tasks; more only make the last groups larger
        rows = rows.withColumn("part", F.floor(F.col("part") / ADDED).cast("int")).groupBy("chunk", "part").applyInArrow(add, kind)
    out, plain = np.zeros(COUNTERS, np.uint32), zstandard.ZstdDecompressor()
    for r in rows.collect():
        at = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
        out[at] = np.minimum(out[at].astype(np.int64) + np.frombuffer(plain.decompress(r["counts"]), np.uint32), 0xFFFFFFFF)
    return out


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bytes: bit i is the parity of the number of tokens that hash to i. A power of two of bits, at least as many as tokens."""
    bits = 1 << max((64 * SKETCH - 1).bit_length(), (len(tokens) - 1).bit_length())
    slots = (tokens >> np.uint64(24)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=bits) & 1, bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same tokens in fewer bytes."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def frequency_rank(sketch: np.ndarray) -> np.ndarray:
    """Doublings above what other tokens put into an average counter."""
    mean = sketch.mean(dtype=np.float64)
    over = np.maximum(sketch - np.float32(mean + 4 * mean**0.5 + 4), 1)
    return np.log2(over).astype(np.uint8)


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_key (a hash of the text as it is), cid (class), n, prefix (the longest, in the global order), sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(frequency_rank(frequency_sketch(docs, k)))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            for at in slices(batch.column("text"), SLICE):
                part = batch.slice(at.start, at.stop - at.start)
                cids, sizes, lists, sketches = [], [], [], []
                for t in shingle_sets(part.column("text"), k):
                    n = len(t)
                    keep = min(n, n - -(-percent * n // 100) + LONGEST)
                    order = np.lexsort((t, rank[(t & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:keep]
                    cids.append(_class_id(t))
                    sizes.append(n)
                    lists.append(t[order].view(np.int64))
                    sketches.append(parity_sketch(t).tobytes() if n else b"")
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(cids, pa.int64()), pa.array(sizes, pa.int32()), prefix, pa.array(sketches, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidy(run), "doc_id long, text_key long, cid long, n int, prefix array<long>, sketch binary")


def sketch_words(classes: DataFrame) -> DataFrame:
    """cid, s0..: the sketch folded to SKETCH words."""
    schema = pa.schema([("cid", pa.int64()), *((f"s{i}", pa.int64()) for i in range(SKETCH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [folded(np.frombuffer(x.as_buffer(), np.uint8), 8 * SKETCH).view("<i8") for x in batch.column("sketch")]
            words = np.stack(words) if words else np.empty((0, SKETCH), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), *(pa.array(words[:, i]) for i in range(SKETCH))], schema=schema)

    return classes.select("cid", "sketch").mapInArrow(tidy(run), "cid long, " + ", ".join(f"s{i} long" for i in range(SKETCH)))


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """token, cid, n, reach, match (the class's l), weight, times: entries of the chosen prefixes in lists of two or more."""
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    every = classes.select("cid", "n", least.alias("least"), F.posexplode("prefix").alias("pos", "token"))
    lists = every.groupBy("token").agg(F.count("*").alias("entries"), F.min("n").alias("n_min")).filter("entries > 1")
    shared = materialise(every.join(lists, "token").select("token", "cid", "n", "least", "pos", "entries", "n_min"), "shared-postings")

    def scanned(l: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pos") < F.col("n") - F.col("least") + l, F.col("entries") - 1)), F.lit(0))

    options = range(1, LONGEST + 1)
    plans = shared.groupBy("cid").agg(
        *[scanned(l).cast("double").alias(f"s{l}") for l in options],
        F.min("least").alias("top"),
        F.sum("entries").alias("weight"),
        F.sort_array(F.collect_list("pos")).alias("places"),
    )
    # No more candidates than entries scanned / l have l matches.
    cost = [F.when(F.col("top") >= l, F.struct((F.col(f"s{l}") * (1 + VERIFY / l)).alias("cost"), F.lit(l).alias("l"))) for l in options]
    plans = plans.select("cid", "weight", "places", F.array_min(F.array_compact(F.array(*cost)))["l"].alias("match"))
    rows = shared.join(plans, "cid").filter(F.col("pos") < F.col("n") - F.col("least") + F.col("match"))
    # Tokens before this one that no other prefix has can't be common to two sets.
    alone = F.col("pos") - (F.array_position("places", F.col("pos")) - 1)
    rows = rows.withColumn("reach", (F.col("n") - alone).cast("int"))
    return merged_lists(rows.filter(F.col("reach") >= least_overlap_column("n", "n_min", percent)).select("token", "cid", "n", "reach", "match", "weight"))


def merged_lists(rows: DataFrame) -> DataFrame:
    """rows with tokens of equal lists as one: token (names the list), cid, n, reach (the largest), match, weight, times (tokens in it).

    Near copies share hundreds of tokens that no one else has; a pair then meets once and not once for each. Lists are
    told apart by a hash of their members; a chance match of hashes only makes a longer list.
    """
    member = F.xxhash64("cid")
    lists = rows.groupBy("token").agg(F.xxhash64(F.count("*"), F.bit_xor(member), F.sum(F.shiftright(member, 20)), F.min("cid"), F.max("cid")).alias("list"))
    out = rows.join(lists, "token").groupBy(F.col("list").alias("token"), "cid")
    return out.agg(F.max("n").alias("n"), F.max("reach").alias("reach"), F.max("match").alias("match"), F.max("weight").alias("weight"), F.count("*").alias("times"))


def least_overlap_column(n: str, m: str, percent: int) -> Column:
    return F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent))


def _side(p: DataFrame, name: str) -> DataFrame:
    return p.select("token", *[F.col(c).alias(f"{name}_{c}") for c in p.columns if c != "token"])


def _has_room(percent: int) -> Column:
    need = least_overlap_column("a_n", "b_n", percent)
    return (F.least("a_reach", "b_reach") >= need) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))


def _differ_little(percent: int) -> Column:
    differ = F.lit(0)
    for i in range(SKETCH):
        differ = differ + F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}")))
    return differ <= F.col("a_n") + F.col("b_n") - 2 * least_overlap_column("a_n", "b_n", percent)


def _counted(rows: DataFrame) -> DataFrame:
    """a, b: pairs that share as many prefix tokens as the smaller l demands."""
    pairs = rows.groupBy(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).agg(F.sum(F.least("a_times", "b_times")).alias("shared"), F.min(F.least("a_match", "b_match")).alias("match"))
    return pairs.filter("shared >= match").select("a", "b")


def anchor_pairs(p: DataFrame, percent: int) -> DataFrame:
    """Each list's members with the list's anchor: its class of most shared tokens. Pairs that share too few tokens with it are left to the second step."""
    anchors = p.groupBy("token").agg(F.max(F.struct("weight", "cid", "n", "reach", "match", "times")).alias("x")).select("token", "x.*")
    rows = _side(p.drop("weight"), "b").join(_side(anchors, "a"), "token").filter(F.col("a_cid") != F.col("b_cid")).filter(_has_room(percent))
    pairs = rows.groupBy("a_cid", "b_cid").agg(F.sum(F.greatest("a_times", "b_times")).alias("shared"), F.min(F.least("a_match", "b_match")).alias("match"))
    return pairs.filter("shared >= match").select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"))


def cross_pairs(p: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of entries of one list from different components: members outside the list's largest component with all others.

    Lists of much the same components are one list here: those with the same largest component and two equal minimum
    hashes over all of them. Long texts that share passages otherwise meet once for each of some hundred tokens. In a joint
    list a pair shares no more tokens than the smaller of its two numbers of tokens there, so none is lost.
    """
    p = p.drop("weight").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node")
    parts = p.groupBy("token", "root").agg(F.count("*").alias("members"))
    least = [F.min(F.xxhash64("root", F.lit(i))) for i in (1, 2)]
    lists = parts.groupBy("token").agg(F.max(F.struct("members", "root"))["root"].alias("large"), F.count("*").alias("parts"), F.xxhash64(*least).alias("alike"))
    lists = lists.filter("parts > 1").select("token", "large", F.xxhash64("large", "alike").alias("list"))
    joint = p.join(lists, "token").groupBy(F.col("list").alias("token"), "cid").agg(*[F.max(c).alias(c) for c in ("n", "reach", "match", "root", "large")], F.sum("times").alias("times"))
    p = materialise(joint.join(sketch_words(classes), "cid"), "cross-postings")
    minor = _side(p.filter("root <> large"), "a")
    rows = minor.join(_side(p, "b"), "token").filter(F.col("a_root") != F.col("b_root"))
    once = (F.col("b_root") == F.col("b_large")) | (F.col("a_cid") < F.col("b_cid"))
    return _counted(rows.filter(once & _has_room(percent) & _differ_little(percent)))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole parity sketches leave room for enough overlap."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(batch.column(c) for c in ("a_n", "b_n", "a_sketch", "b_sketch")))):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                total = n.as_py() + m.as_py()
                if int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= total - 2 * least_overlap(total, 0, percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(tidy(run), "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, cid, tokens (sorted, binary) of documents that may stand for a wanted class: wanted has their ids as first."""
    slot = F.pmod(F.xxhash64("first"), F.lit(FILTER_BITS))
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(first), {FILTER_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filter_words = np.zeros(FILTER_BITS // 64, np.int64)
    filter_words[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(filter_words)
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
            for part in slices(batch.column("text"), SLICE):
                rows = [(d, _class_id(t), t.tobytes()) for d, t in zip(batch.column("doc_id")[part.start : part.stop].to_pylist(), shingle_sets(batch.column("text")[part.start : part.stop], k))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)).alias("slot"), "text").mapInArrow(tidy(run), "doc_id long, cid long, tokens binary")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, from their whole sets."""
    pairs = materialise(plausible(materialise(pairs, f"{tag}-pairs"), classes, percent), f"{tag}-candidates")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(groups, "a").select(F.col("b").alias("cid"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("turn"))
    heads = groups.select(F.col("a").alias("cid"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"))
    wanted = materialise(members.unionByName(heads).join(classes.select("cid", "first"), "cid"), f"{tag}-wanted")
    sets = sets_of(docs, wanted.select("first").distinct(), k).withColumnsRenamed({"cid": "own", "doc_id": "of"})
    rows = sets.join(wanted, (F.col("own") == F.col("cid")) & F.col("of").eqNullSafe(F.col("first"))).select("a", "part", "turn", "cid", "tokens")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, turn, cid, tokens in zip(*(batch.column(c) for c in ("a", "turn", "cid", "tokens"))):
                y = np.frombuffer(tokens.as_buffer(), np.uint64)
                if turn.as_py() == 0:
                    at, x = a.as_py(), y.copy()
                    continue
                assert a.as_py() == at, "a member came without its class"
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    found.append((at, cid.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], schema=schema)

    met = rows.repartition("a", "part").sortWithinPartitions("a", "part", "turn").select("a", "turn", "cid", "tokens")
    return materialise(met.mapInArrow(tidy(run), "a long, b long").distinct(), f"{tag}-links")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key, cid, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select("doc_id", "text")
    rows = materialise(prefixes(docs, k, percent), "prefixes")
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min(F.struct("n", "prefix", "sketch")).alias("x"), F.min("doc_id").alias("first"))
    classes = materialise(classes.select("cid", "x.n", "x.prefix", "x.sketch", "first"), "classes")
    p = materialise(postings(classes, percent), "postings")
    links = verified(docs, classes, anchor_pairs(p, percent), k, percent, "anchor")
    more = verified(docs, classes, cross_pairs(p, classes, components(links), percent), k, percent, "cross")
    roots = components(links.unionByName(more))
    named = classes.select("cid", "first").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named = materialise(named.select("cid", "root", "first"), "named")
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = named.join(names, "root").select(F.col("cid").alias("class"), "component_id")
    out = rows.select("doc_id", "text_key", "cid", "n").join(by_class, F.col("cid") == F.col("class"), "left")
    return out.select("doc_id", "text_key", "cid", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
