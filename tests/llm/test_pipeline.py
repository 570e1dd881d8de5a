"""The pipeline against a brute-force version on a small table."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from postmill.llm import langid
from postmill.llm.python_queries import tokenizer_path
from postmill.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(8)
    words = {"en": [f"{a}{b}" for a in "the and ing ion ent".split() for b in "a e o st er".split()], "de": [f"{a}{b}" for a in "sch und ich ver ung".split() for b in "ä ö en te ß".split()]}
    rows = []
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        rows.append([i, " ".join(rng.choices(words[lang], k=rng.randrange(5, 120))), lang, f"s{i % 4 if i % 2 else 0}"])
    for i in range(160, 200):  # exact copies, some near copies
        base = rng.choice(rows[:30])
        text = base[1].split()
        if i % 2:
            text[rng.randrange(len(text))] = "changed"
        rows.append([i, " ".join(text), base[2], rng.choice(["s0", None])])
    rows += [[200, None, "en", "s1"], [201, "", None, "s1"], [202, "12 34 !", "en", "s2"], [203, "a", None, "s2"]]
    return [(*r, len(r[1] or "")) for r in rows]


def near_losers(rows, k=5, percent=80):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return {d for g in groups.values() for d in g if d != min(g)}


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    folder = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")

    left = [r for r in rows if any(ch.isalpha() for ch in r[1] or "")]
    largest = {}
    for r in left:
        largest[r[1]] = max(largest.get(r[1], -1), r[0])
    left = [r for r in left if largest[r[1]] == r[0]]
    lost = near_losers(left)
    left = [r for r in left if r[0] not in lost]
    assert lost

    found = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, found, folder)
        assert found.columns == docs.columns, name
    assert sorted(tuple(r) for r in found.collect()) == sorted(left)

    mixed = corpus_pipeline.STAGES[3][1](spark, found, folder).collect()
    copies, sizes, taken = Counter(r.doc_id for r in mixed), defaultdict(int), defaultdict(int)
    for r in left:
        sizes[r[3]] += len(r[1].split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert set(copies) <= {r[0] for r in left} and max(copies.values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())

    pieces = corpus_pipeline.run(spark, folder).collect()
    encode = Encoder(tokenizer_path("byte_bpe_50k.json")).encode_whole
    texts = {r[0]: r[1] for r in left}
    count, bins = Counter(), defaultdict(int)
    for p in pieces:
        ids = encode(texts[p.doc_id]) + [0]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        count[p.doc_id] += p.length
        bins[p.sequence_id] += p.length
    assert {d: n // len(encode(texts[d]) + [0]) for d, n in count.items()} == dict(copies)
    assert max(bins.values()) <= 1024


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and shared ids, repeated rows, a very long text, extra columns with names that stages use."""
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "lmnrst"]
    base = " ".join(rng.choices(words, k=80))
    near = base.replace(base.split()[40], "changed", 1)
    other, fresh, long = (" ".join(rng.choices(words, k=k)) for k in (60, 50, 60_000))
    rows = [(1, base), (5, near), (5, other), (5, other), (None, near), (None, fresh), (7, long), (8, long), (9, None), (9, "1 2 3"), (1, base)]
    schema = SCHEMA + ", row string, own int, key int, id int, total int, part int, turn int"
    docs = spark.createDataFrame([(d, t, "en" if d else None, "s", len(t or ""), "r", 1, 2, 3, 4, 5, 6) for d, t in rows], schema)
    folder = str(tmp_path / "odd")
    docs.write.parquet(f"{folder}/documents.parquet")
    found = docs
    want = [
        Counter((d, t) for d, t in rows if t and any(c.isalpha() for c in t)),
        Counter([(1, base), (5, near), (5, other), (None, fresh), (8, long)]),
        Counter([(1, base), (5, other), (None, fresh), (8, long)]),
    ]
    for (name, stage), left in zip(corpus_pipeline.STAGES[:3], want):
        found = corpus_pipeline.materialise(stage(spark, found, folder), "odd")
        assert found.columns == docs.columns and Counter((r.doc_id, r.text) for r in found.collect()) == left, name
    mixed = corpus_pipeline.STAGES[3][1](spark, found, folder)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {1, 5, None, 8} and mixed.count() > 0
    assert {r.row for r in mixed.collect()} == {"r"}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} <= {1, 5, None, 8} and pieces


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_language_stage_rejects_only_texts_without_a_letter(spark):
    schema = "doc_id long, text string, lang string"
    texts = ["the cat and the dog", "²the ½and ½cup ²a", "½ ² 12", "", None]
    for lang in ("en", None):
        docs = spark.createDataFrame([(i, t, lang if i == 0 else None) for i, t in enumerate(texts)], schema)
        assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {0, 1}
    docs = spark.createDataFrame([(0, texts[0], "en"), (1, texts[1], None), (2, texts[2], None)], schema)
    got = {r.row.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {0: "en", 1: "en", 2: "und"}
