"""Decontamination, Merkle manifest and filter audit against brute force; nulls, ties, repeats, empty tables, clashing columns."""

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import decontaminate, interactions, merkle

LONG = "Some words of a very long text, again. " * 4000


# --- decontamination


def plain_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, width):
    windows = {}
    for item, text in items:
        ws = plain_words(text)
        for a in range(max(1, len(ws) - width + 1)) if ws else ():
            windows.setdefault(tuple(ws[a : a + width]), set()).add(item)
    out = []
    for d, text in docs:
        ws, hit, found = plain_words(text), set(), set()
        for a in range(len(ws)):
            for b in range(a + 1, min(len(ws), a + width) + 1):
                if tuple(ws[a:b]) in windows:
                    hit |= set(range(a, b))
                    found |= windows[tuple(ws[a:b])]
        out.append((d, len(ws), tuple(sorted(hit)), tuple(sorted(str(i) for i in found if i is not None))))
    return Counter(out)


def bench_tables():
    rng = random.Random(7)
    words = ["Ab", "c", "é1", "dd", "E", "9", "ñ", "x_y", "z"]
    say = lambda n: rng.choice([" ", ", ", "\n", "\x00"]).join(rng.choices(words, k=n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 6, 12]) if i % 3 else 5)) for i in range(25)] + [(100, None), (101, " ."), (None, say(4)), (3, say(4)), (7, say(4))]
    docs = [(i, say(rng.randrange(0, 40))) for i in range(60)] + [(70, None), (71, ""), (72, "..."), (None, items[0][1]), (5, items[3][1]), (5, items[3][1]), (73, LONG)]
    return docs, [(i, t) for i, t in items if not t or len(plain_words(t)) > 2 or i == 1]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20), (1 << 20, 60), (90, 1 << 20), (90, 60)])
def test_scan_against_brute_force(spark, sizes):
    docs, items = bench_tables()
    df = spark.createDataFrame([(d, t, 1, "r") for d, t in docs], "doc_id long, text string, n_words int, row string").withColumn("spans", F.lit(7))
    found = decontaminate.scan(df, spark.createDataFrame(items, "item_id long, text string"), 4, *sizes).collect()
    got = Counter((r.row.doc_id, r.n_words, tuple(x for s in r.spans for x in range(s.first, s.end)), tuple(r.item_ids)) for r in found)
    assert got == brute_hits(docs, items, 4) and sum(bool(k[2]) for k in got) > 10
    for r in found:
        ws = plain_words(r.row.text)
        for s in r.spans:
            assert plain_words(r.row.text[s.from_char : s.to_char]) == ws[s.first : s.end]


def test_cut_takes_spans_out(spark):
    df = spark.createDataFrame([(1, "Keep this. Ab c é1! dd, and that"), (2, "nothing here"), (3, "ab c é1 dd"), (4, None)], "doc_id long, text string")
    found = decontaminate.scan(df, spark.createDataFrame([("q", "ab C É1 ab c é1 dd".replace("É", "é"))], "item_id string, text string"), 4)
    got = {r.id: r.cut for r in found.select(F.col("row.doc_id").alias("id"), decontaminate.cut(F.col("row.text"), F.col("spans")).alias("cut")).collect()}
    assert got == {1: "Keep this. , and that", 2: "nothing here", 3: "", 4: None}


def test_scan_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.spans, r.item_ids) for r in decontaminate.scan(docs, items.limit(0)).collect()] == [(2, [], [])]


# --- Merkle manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """Levels from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_root(groups):
    """Root over the subroots, groups in order."""
    return brute_tree([brute_tree(g)[-1][0] for g in groups])[-1][0]


def corpus(n, langs):
    rows = [(i * 3 % n if i % 5 else i, ["s", None, "ü"][i % 3], langs[i * i % len(langs)], i % 11 if i % 4 else None, f"text {i % 7}") for i in range(n)]
    return rows + rows[:3] + [(None, None, None, None, None), (None, "s", langs[0], 5, "x")]


@pytest.mark.parametrize("bits,part_rows", [(2, 10), (1, 1000), (8, 7)])
def test_manifest_against_whole_trees(spark, bits, part_rows):
    rows = corpus(61, ["en", "de", "", None, "fr", "zz"]) + [(9, "s", "only", 1, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("grp", "pos", "id", "node", "turn")})
    bad = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    found = merkle.manifest(df, {"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bits=bits, part_rows=part_rows)
    got = found.withColumn("native", merkle.fold(F.lower(F.hex(F.coalesce(F.get("copied", F.lit(0)), "leaf"))), F.col("proof"))).collect()
    order = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted([r for r in rows if r[2] == g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for g in order}
    leaves = {g: [brute_leaf(r) for r in rs] for g, rs in groups.items()}
    trees = {g: brute_tree(x) for g, x in leaves.items()}
    top = brute_tree([trees[g][-1][0] for g in order])
    want = Counter()
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            siblings, k = [], i
            for level in trees[g][:-1]:
                siblings += level[k ^ 1 : (k ^ 1) + 1]
                k >>= 1
            k = at
            for level in top[:-1]:
                siblings += level[k ^ 1 : (k ^ 1) + 1]
                k >>= 1
            changed = r[0] is not None and r[0] % 4 == 0 and r[3] is not None
            other = leaves[g][:i] + [brute_leaf((*r[:3], r[3] + 1, r[4])) if changed else leaves[g][i]] + leaves[g][i + 1 :]
            want[(r[0], leaves[g][i], trees[g][-1][0], top[-1][0], tuple(siblings), brute_root([other if x == g else leaves[x] for x in order]), len(trees[g]) + len(top) - 1 if changed else None)] += 1
    short = lambda r: tuple(s[1:].hex() for s in r.proof if len(s) > 1)
    assert Counter((r.id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), short(r), r.folded_root.hex(), r.copied and len(r.copied)) for r in got) == want
    assert all(r.native == r.folded_root.hex() for r in got)
    assert sum(r.folded_root != r.root for r in got) == sum(c for k, c in want.items() if k[-1]) > 5


def test_versions_share_what_they_do_not_copy():
    nodes = [bytes([i]) * 32 for i in range(13)]
    block = merkle.Block.grow(nodes, 13)
    before = [list(level) for level in block.levels]
    for place in range(13):
        copied = block.version(b"\xff" * 32, block.steps(place))
        other = merkle.Block.grow(nodes[:place] + [b"\xff" * 32] + nodes[place + 1 :], 13)
        for k, level in enumerate(block.levels):
            assert [copied[k] if i == place >> k else n for i, n in enumerate(level)] == other.levels[k]
    assert block.levels == before == merkle.Block.of(block.packed()).levels


def test_manifest_of_one_row_and_none(spark):
    df = spark.createDataFrame([(4, None, None, 2, LONG)], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = merkle.manifest(df, {}).collect()
    leaf = brute_leaf((4, None, None, 2, LONG))
    assert (r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof, r.copied) == (leaf, leaf, leaf, [], None)
    assert merkle.manifest(df.limit(0), {}).count() == 0


# --- filter audit

sorted_ids = st.lists(st.integers(0, 60), unique=True, max_size=40).map(sorted)


@settings(max_examples=200, deadline=None)
@given(sorted_ids, sorted_ids, st.integers(0, 70))
def test_galloping(a, b, x):
    assert interactions.merged(a, b) == sorted({*a, *b})
    assert interactions.beyond(a, b) == len({*a} - {*b})
    assert interactions.gallop(a, x, 0) == sum(i < x for i in a)


def brute_audit(docs, labels):
    texts = [(d, part or "", t or "") for d, part, t in docs]
    first = {}
    for d, _, t in texts:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    judged = []
    for d, part, t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        judged.append((part, d in good, d in toxic, {f for f, v in fails.items() if v}))
    out = {}
    for part in {j[0] for j in judged}:
        own, shapley = [j for j in judged if j[0] == part], Counter()
        for p in permutations("ABCDE"):
            left = own
            for k, f in enumerate(p):
                gone = [j for j in left if f in j[3]]
                left = [j for j in left if f not in j[3]]
                shapley[f] += len(gone)
                fails = sum(f in j[3] for j in own)
                out[(part, "".join(p), k + 1)] = [len(left), len(gone), fails - len(gone), sum(j[3] == {f} for j in own), sum(j[1] for j in gone), sum(j[2] for j in gone)]
        for (at, p, k), row in out.items():
            if at == part:
                row.append(shapley[p[k - 1]])
    return out


@pytest.mark.parametrize("bits", [14, 3])
def test_audit_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(interactions, "RANGE_BITS", bits)
    rng = random.Random(2)
    say = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    pool = [None, "", " \n", say(250, 30), say(250, 4000), say(20, 40), "AB # cd", say(300, 9000) + "\x0b|", say(220, 5000) + " THE END " * 9, LONG, "é" * 300]
    docs = [(rng.choice([None, *range(300)]), rng.choice(["en", "de", None, ""]), rng.choice(pool) if rng.random() < 0.7 else say(rng.choice([30, 260]), 5000)) for _ in range(260)]
    docs += [(900 + i, "clean", say(240, 10**6)) for i in range(3)] + [(5, "en", "twice"), (5, "en", "twice")]
    labels = [(rng.choice([None, *range(300)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({c: F.lit(1) for c in ("good", "A", "words", "first", "text_sha", "part", "rid")})
    got = interactions.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == brute_audit(docs, labels)
    assert len(got) == 4 * 600


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "en", "a")], "doc_id long, lang string, text string"), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert interactions.audit(docs.limit(0), labels).count() == 0
    got = interactions.audit(docs, labels.limit(0)).collect()
    assert len(got) == 600 and {(r.removed, r.good_lost) for r in got} == {(0, 0), (1, 0)}
