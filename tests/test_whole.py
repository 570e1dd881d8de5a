"""Queries and operators against brute force where a cut would lose rows."""

import datetime
import math
import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postmill.functions.vectors import cosine
from postmill.operators import dedup, fold, vector_pairs
from postmill.plans import texts
from postmill.plans.standins import Tables


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, " \n", "one", "One", "one two"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        texts += [" ".join(base), "  " + " ".join(base), "Title " + " ".join(base), " ".join(["changed", *base[1:]]), " ".join(reversed(base)), " ".join(base[:-3])]
    rng.shuffle(texts)
    return list(enumerate(texts))


def near_pairs(rows, least):
    sets = {i: set((t or "").lower().split()) for i, t in rows}
    score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0.0
    return {(a, b): score(a, b) for a, b in combinations(sorted(sets), 2) if score(a, b) >= least}


def test_near_classes_stand_for_every_pair(spark, tmp_path):
    rows = near_texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    sets = {i: frozenset((t or "").lower().split()) for i, t in rows}
    want = {k: round(v, 6) for k, v in near_pairs(rows, 0.85).items()}
    near = {r.doc_id: r for r in run("d4_near_dup")}
    assert set(near) == {i for i in sets if sets[i]} and len(want) > 40
    for i, r in near.items():
        same = [j for j in near if sets[j] == sets[i]]
        assert (r["class"], r.class_size, r.n_links) == (min(same), len(same), sum(i in pair for pair in want))
    members = lambda rows: {c: [r.doc_id for r in rows if r["class"] == c] for c in {r["class"] for r in rows}}
    of = members(near.values())
    got = {(a, b): 1.0 for ids in of.values() for a, b in combinations(sorted(ids), 2)}
    for r in run("d4_class_pairs"):
        assert r.pairs == len(of[r.earlier]) * len(of[r.later])
        got |= {(min(a, b), max(a, b)): r.jaccard for a in of[r.earlier] for b in of[r.later]}
    assert got == want
    text = {i: (t or "")[:500].lower() for i, t in rows}
    want = {(b, a): round(SequenceMatcher(None, text[b], text[a]).ratio(), 6) for a, b in near_pairs(rows, dedup.PREFILTER)}
    of = members(run("t22_classes"))
    got = {(b, a): 1.0 for ids in of.values() for a, b in combinations(sorted(ids), 2)}
    for r in run("t22_sequence_ratio"):
        assert (r.later_size, r.earlier_size) == (len(of[r.later]), len(of[r.earlier]))
        got |= {(b, a): r.similarity for b in of[r.later] for a in of[r.earlier] if a < b}
    assert got == want


def test_letters_bound_the_ratio(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices("abe é😀#z", k=rng.randrange(0, 30))) for _ in range(60)]
    rows = spark.createDataFrame([(a, b) for a, b in zip(texts, texts[1:])], "a string, b string")
    may = dedup.may_reach(dedup.letter_counts(F.col("a")), dedup.letter_counts(F.col("b")), 0.6)
    got = rows.select("a", "b", may.alias("may")).collect()
    assert all(r.may for r in got if SequenceMatcher(None, r.a, r.b).ratio() >= 0.6) and not all(r.may for r in got)


def test_similar_vectors_of_all_tiles(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + 0.25 * rng.normal(size=(150, 24)), rng.normal(size=(150, 24)), np.zeros((2, 24))])
    rows = [(("a", "b")[i % 5 == 0], i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "block string, id long, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {(i, j) for i, j in combinations(range(len(x)), 2) if rows[i][0] == rows[j][0] and u[i] @ u[j] >= 0.92}
    for tile in (40, 1000):
        pairs, work = vector_pairs.similar(df, 0.92, cosine, tile)
        assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 100
        done = work.agg(F.sum("met"), F.sum("compared")).first()
        assert len(want) < done[1] < 0.1 * len(x) ** 2 and done[0] <= len(x) ** 2
    assert vector_pairs.similar(df.limit(0), 0.92, cosine)[0].count() == 0


def test_whole_products_are_few():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x[1000:1100] = x[:100] + 0.1 * rng.normal(size=(100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, n = vector_pairs.near_rows(x, x, 0.92)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b} == {(k, 1000 + k) for k in range(100) if x[k] @ x[1000 + k] >= 0.92}
    assert n < 0.02 * 2000**2


def test_rollup_takes_every_event(spark, tmp_path):
    events = [(i, i % 7, "error" if i % 7 == 3 or (i % 7 == 4 and i > 60) else "view") for i in range(100)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for source in range(7):
        own = [e for e in events if e[1] == source]
        ok = [e[2] != "error" for e in own]
        want[source] = (len(own), sum(e[0] % 10 for e in own), "success" if all(ok) else "partial_success" if any(ok) else "failed")
    got = entry.queries()["a9_rollup"](spark, str(tmp_path)).collect()
    assert {r.source: (r.attempts, r.fetched, r.status) for r in got} == want and len(got) == 7


def test_components_take_every_posting(spark):
    sf = "/root/testdata/sf0.001"
    rows = texts.fold_rows(Tables(spark, sf)).collect()
    root = {r.pos: r.pos for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    norm = lambda v: "".join(c for c in (v or "").lower() if c.isascii() and c.isalnum())
    for r in rows:
        meta = tuple(norm(v) for v in (r.normalized_company, r.normalized_title, r.normalized_location, r.employment_type)) + (norm(r.source_job_id) if r.source_job_id else "generic",)
        keys = [("url", r.source_url), ("apply", r.application_url), ("id", r.source_job_id and (r.source, r.source_job_id)), ("meta", meta)]
        for key in (k for k in keys if k[1]):
            a, b = find(first.setdefault(key, r.pos)), find(r.pos)
            root[max(a, b)] = min(a, b)
    found = {p: find(p) for p in root}
    sizes = {}
    for r in found.values():
        sizes[r] = sizes.get(r, 0) + 1
    got = entry.queries()["d6_components"](spark, sf).collect()
    assert {r.node: r.root for r in got} == {p: r for p, r in found.items() if sizes[r] > 1} and len(rows) == Tables(spark, sf).postings.count()


def postings():
    """Postings that meet on every level, with ties, nulls and empty values."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    bases = [" ".join(rng.choices(words, k=30)) for _ in range(6)]
    out = []
    for i in range(160):
        text = rng.choice([*bases, "", None, rng.choice(bases) + " x" * rng.choice([1, 2, 60])])
        if text and rng.random() < 0.3:
            w = text.split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        angle = rng.choice([0.0, 0.1, 0.35, 1.5, 1.6, 3.0])
        out.append({
            "pos": i, "source": rng.choice("ab"), "source_job_id": rng.choice([None, "", f"j{rng.randrange(150)}"]), "normalized_company": f"c{rng.randrange(5)}", "normalized_title": f"t{rng.randrange(40)}",
            "normalized_location": f"l{rng.randrange(4)}", "employment_type": "FULL_TIME", "source_url": rng.choice([None, "", f"u{rng.randrange(120)}"]), "title": f"title {i}",
            "application_url": rng.choice([None, f"https://careers.x/{rng.randrange(150)}", f"https://linkedin.com/{i}"]), "description": text,
            "posted_at": rng.choice([None, datetime.datetime(2024, 1, rng.randrange(1, 28))]), "embedding": rng.choice([None, [math.cos(angle), math.sin(angle)]]),
        })
    return out


POSTING = "pos long, source string, source_job_id string, normalized_company string, normalized_title string, normalized_location string, employment_type string, source_url string, title string, application_url string, description string, posted_at timestamp, embedding array<double>"


def brute_fold(rows, vectors):
    """One posting after another against all canonical ones: final canonical, beaten by, reason, and what each took in."""
    norm = lambda v: "".join(c for c in (v or "").lower() if c.isascii() and c.isalnum()) if v else "generic"
    meta = lambda r: tuple(norm(r[k]) for k in ("normalized_company", "normalized_title", "normalized_location", "employment_type", "source_job_id"))
    direct = lambda r: "careers" in (r["application_url"] or "") and "linkedin.com" not in r["application_url"]

    def why(a, b):
        equal = lambda k: a[k] and a[k] == b[k]
        if equal("source_url") or equal("application_url"):
            return "LEVEL_1_EXACT_URL"
        if a["source"] == b["source"] and equal("source_job_id"):
            return "LEVEL_2_SOURCE_JOB_ID"
        if meta(a) == meta(b):
            return "LEVEL_3_NORMALIZED_METADATA"
        if a["normalized_company"] != b["normalized_company"]:
            return None
        x, y = ((r["description"] or "").lower() for r in (a, b))
        u, v = set(x.split()), set(y.split())
        if u and v and len(u & v) / len(u | v) >= 0.65 and (ratio := SequenceMatcher(None, x[:500], y[:500]).ratio()) >= 0.85:
            return f"LEVEL_4_FUZZY_DESCRIPTION ({round(ratio, 2)})"
        if vectors and a["embedding"] and b["embedding"] and (cos := sum(p * q for p, q in zip(a["embedding"], b["embedding"]))) >= 0.92:
            return f"LEVEL_5_EMBEDDING_SIMILARITY ({round(cos, 2)})"
        return None

    def beats(new, old):
        if direct(new) != direct(old):
            return direct(new)
        more = len(new["description"] or "") - len(old["description"] or "")
        if abs(more) > 100:
            return more > 0
        return bool(new["posted_at"] and old["posted_at"] and new["posted_at"] > old["posted_at"])

    slots, slot_of, lost, took = [], {}, {}, {}
    for r in rows:
        at, reason = next(((i, w) for i, c in enumerate(slots) if (w := why(r, c))), (len(slots), None))
        slot_of[r["pos"]] = at
        if reason is None:
            slots.append(r)
            continue
        winner, loser = (r, slots[at]) if beats(r, slots[at]) else (slots[at], r)
        slots[at], lost[loser["pos"]] = winner, (winner["pos"], reason)
        own = took.setdefault(winner["pos"], [])
        if all(o["source_url"] != loser["source_url"] for o in own):
            own.append(loser)
    return {p: (slots[i]["pos"], *lost.get(p, (None, None))) for p, i in slot_of.items()}, {c["pos"]: took[c["pos"]] for c in slots if c["pos"] in took}


def test_fold_against_one_posting_after_another(spark):
    rows = postings()
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in POSTING.split(", ")) for r in rows], POSTING)
    for vectors, most in ((False, 70), (True, fold.MOST)):
        want, took = brute_fold(rows, vectors)
        folded = dedup.deduplicate(df, vectors, most)
        assert {r.pos: (r.canonical, r.merged_into, r.reason) for r in folded.collect()} == want
        levels = {w[2][:7] for w in want.values() if w[2]}
        assert levels == {f"LEVEL_{i}" for i in range(1, 5 + vectors)}
        got = {r.pos: [o.source_url or None for o in r.other_sources] for r in dedup.merged_sources(df, folded).collect()}
        plain = lambda urls: [u for i, u in enumerate(urls) if u not in urls[:i]]
        assert got == {p: plain([o["source_url"] or None for o in own]) for p, own in took.items()}
        audit = {r.pos: (r.duplicate_title, r.canonical_title, r.reason) for r in dedup.merge_audit(df, folded).collect()}
        assert audit == {p: (f"title {p}", f"title {w[1]}", w[2]) for p, w in want.items() if w[1] is not None}
    first, _ = brute_fold(rows, False)
    second, _ = brute_fold([r for r in rows if first[r["pos"]][1] is None], True)
    want = second | {p: (second[w[0]][0], *w[1:]) for p, w in first.items() if w[1] is not None}
    assert {r.pos: (r.canonical, r.merged_into, r.reason) for r in dedup.deduplicate_in_stages(df).collect()} == want
    assert dedup.deduplicate_in_stages(df.limit(0)).count() == 0


def test_fold_of_one_component_in_turns(spark):
    """A chain of keys joins all postings; the fold in turns is the fold in one task, and no task is larger than said."""
    rng = random.Random(9)
    n, most = 120, 50
    spread = [sorted(rng.sample(range(3 * i // 4, 3 * i // 4 + 8), 2)) if i % 9 else [3 * i // 4, 5000] for i in range(n)]
    keys = [(i, 1 + k % 3, k) for i, own in enumerate(spread) for k in own]
    links = [(4, k, k + 1, 0.9) for k in range(0, 3 * n // 4, 5)]
    facts = [(i, [1 + k % 3 for k in spread[i]], spread[i], rng.randrange(2), rng.randrange(400), rng.random() < 0.8, rng.randrange(50)) for i in range(n)]
    held = fold.Fold()
    for _, later, earlier, similarity in links:
        held.links.setdefault(later, []).append((earlier, 4, similarity))
    for pos, levels, own, direct, length, dated, posted in facts:
        held.take({"pos": pos, "levels": levels, "keys": own, "direct": direct, "length": length, "dated": dated, "posted": posted})
    told = held.results()
    postings = spark.createDataFrame(facts, "pos long, levels array<int>, keys array<long>, direct int, length int, dated boolean, posted long")
    merges, slots, largest = fold.fold(postings, spark.createDataFrame(keys, "pos long, level int, key long"), spark.createDataFrame(links, "level int, later long, earlier long, similarity double"), most)
    assert {(r.pos, r.merged_into, r.level, r.similarity) for r in merges.collect()} == {t[1:] for t in told if t[0] == fold.MERGED}
    stands = {t[1]: t[2] for t in told if t[0] == fold.STANDS}
    assert {(r.pos, r.canonical) for r in slots.collect()} == {(t[1], stands[t[2]]) for t in told if t[0] == fold.TAKEN}
    assert len(largest) > 2 and max(largest) <= most
