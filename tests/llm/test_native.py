"""The operators in DataFrame expressions: brute force, nulls, empty and long texts, ties, empty tables, clashing columns."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postmill.llm import chat, exact, lines, mixing

SCHEMA = "doc_id long, text string, lang string, source string, recipe int, kept int, size int, target int, lost int"
#: Names that operators may use inside.
CLASHING = ["__id", "__own", "__sha", "__turn", "__hash", "__each", "__copy", "id", "own", "row", "key", "of", "total", "copies", "rid", "h", "pos", "lines"]
LONG = "Words of a long text. " * 3000


def table(spark, rows):
    return spark.createDataFrame([(*r, "en", f"s{(r[0] or 0) % 3}", 1, 2, 3, 4, 5) if len(r) == 2 else (*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).select("*", *[F.lit(7).alias(c) for c in CLASHING])


TEXTS = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, LONG), (6, LONG + "x"), (7, LONG), (None, "a"), (9, "b\n"), (9, "b\n"), (10, "a ")]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_copies(spark, bits):
    got = exact.mark_copies(table(spark, TEXTS), bits=bits).collect()
    groups = defaultdict(list)
    for d, t in TEXTS:
        groups[t or ""].append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for k, d in enumerate(ids):
            first = d == keep and ids.index(d) == k
            want[(d, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_recipes_cover_the_text(spark):
    texts = [LONG, "no boundary " * 900, "ends.\n" * 400, "é" * 5000, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", exact.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in got)
    assert max(len(c) for r in got for c in r.c) <= exact.MAX + 2


def test_drop_copies_keeps_columns_and_one_row(spark):
    rows = table(spark, TEXTS)
    got = exact.drop_copies(rows)
    assert got.columns == rows.columns
    assert sorted(((r.text or ""), r.doc_id) for r in got.collect()) == sorted([("a", 4), ("", 3), (LONG, 7), (LONG + "x", 6), ("b\n", 9), ("a ", 10)])


def test_exact_empty_table(spark):
    assert exact.mark_copies(table(spark, [])).count() == 0 == exact.drop_copies(table(spark, [])).count()


def brute_lines(rows, least, docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen, split = defaultdict(set), [(d, (t or "").split("\n")) for d, t in rows]
    for n, (d, ls) in enumerate(split):
        for k in {key(x) for x in ls}:
            if len(k) >= least:
                seen[k].add((d, n if d is None else 0))
    holder = {k: max((d for d, _ in ids if d is not None), default=None) for k, ids in seen.items() if len(ids) >= docs}
    out = []
    for d, ls in split:
        kept = [x for x in ls if holder.get(key(x), d) == d]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines_against_brute_force(spark):
    c = "A common line, of more than twenty"
    rows = [(1, f"{c}\nown one"), (2, f"x\n  {c.upper()}\t\n{c}"), (3, f"{c}\n{c}\n\nend"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (None, c), (9, "é" * 20), (10, "é" * 20), (11, "É" * 20 + "\n" + "é" * 20), (12, LONG)]
    got = lines.drop_lines(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows, 20, 3)
    twice = [(1, f"{c}\na"), (1, f"{c}\nb"), (1, c), (2, c), (3, "é" * 30), (4, "é" * 30), (5, "é" * 30), (5, "é" * 30), (None, "ñ" * 30), (None, "ñ" * 30), (6, "ñ" * 30)]
    got = lines.drop_lines(table(spark, twice)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(twice, 20, 3)
    assert {(r.doc_id, r.n_dropped) for r in got if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}  # two documents have that line


def test_lines_empty_table(spark):
    assert lines.drop_lines(table(spark, [])).count() == 0


def test_word_count(spark):
    texts = ["", " ", "a", " a\x0bb\n", "a b c", None, "x " * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.n_words(F.coalesce("text", F.lit(""))).alias("n")).collect()
    assert [r.n for r in got] == [len((r.text or "").encode().split()) for r in got]


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_targets_and_counts(spark):
    rows = [(i, "w " * (1 + i * i % 37), "en", ["a", "B", None, "ü", "z"][i % 5 if i % 3 else 0]) for i in range(600)] + [(None, "q q", "en", "a"), (700, None, "en", "none"), (5, "again", "en", "a")]
    plan = mixing.plan_mix(table(spark, rows)).collect()
    assert len(plan) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = fill(dict(sizes)), defaultdict(int)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 37 * 6
    again = mixing.plan_mix(table(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in again) == Counter((r.doc_id, r.size, r.copies) for r in plan)
    mixed = mixing.mix(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns
    assert mixed.count() == sum(r.copies for r in plan)


def test_mix_empty_table(spark):
    assert mixing.plan_mix(table(spark, [])).count() == 0 == mixing.mix(table(spark, [])).count()


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "user", "### user: </turn>\n\\h\\e\\l<#"), (1, 2, "assistant", "a\\"), (1, 3, "assistant", None), (1, 4, "system", ""),
        (2, 5, "a: b#<", "</part>"), (None, 1, None, "x"), (3, 1, "user", "t"), (3, 1, "assistant", "t"), (3, 1, "user", "t"), (4, 0, "assistant", LONG),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn, role or "", text or ""))
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss_text == "".join(t for _, r, t in turns if r == "assistant")
    assert got[1].formatted.count("### ") == 3  # two user turns are one block
    assert chat.format_chats(df.limit(0)).count() == 0
