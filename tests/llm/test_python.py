"""The operators with Python inside tasks, against brute force."""

import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import audio, components, jaccard, langid, packing, substrings, tokenfile
from postmill.llm.python_queries import codec_of, tokenizer_path
from postmill.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, cid int, block int, score int, row int, sequence_id int"
WORDS = [f"w{i}" for i in range(300)]


def table(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def encoders():
    return {f: Encoder(tokenizer_path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x01.,;'\"-_#aZé1½ßİǅ́ 　\x1c"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_library(encoders, texts):
    for e in encoders.values():
        for text, ids in zip(texts, e.batch(pa.array(texts, pa.string()))):
            assert ids.tolist() == e.encode_whole(text), text


def test_ids_of_special_and_null(encoders):
    texts = [None, "", "x <|endoftext|> y", "a\n\nb", "<|startoftext|>", "it's you'll", "word " * 2000]
    for e in encoders.values():
        assert [x.tolist() for x in e.batch(pa.array(texts))] == [e.encode_whole(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 64)
    room: list[int] = []
    for size, b, at in zip(sizes, bins, offsets):
        k = next((i for i, r in enumerate(room) if r >= size), len(room))
        if k == len(room):
            room.append(64)
        assert (b, at) == (k, 64 - room[k])
        room[k] -= size


def test_packing(spark, encoders):
    rows = [(i, "the quick brown fox " * (i * 7 % 60)) for i in range(300)] + [(400, None), (401, ""), (402, "long " * 30000), (None, "x"), (5, "twice"), (5, "twice")]
    path, e = tokenizer_path("byte_bpe_50k.json"), encoders["byte_bpe_50k.json"]
    packed = packing.pack_documents(table(spark, rows), path, 0, group=64)
    got = packed.collect()
    docs, bins = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t in rows[:303]:
        if d != 5:  # that id occurs three times
            assert sum((ids for _, ids, _ in sorted(docs[d])), []) == e.encode_whole(t or "") + [0]
            assert all(n == len(e.encode_whole(t or "")) + 1 for *_, n in docs[d])
    assert len(docs[5]) == 3 and len(docs[None]) == 1
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    used = sum(r.length for r in got)
    assert len(bins) * 1024 < used * 1.15
    padded = packing.sequences(packed).collect()
    assert {r.sequence_id for r in padded} == set(bins) and all(len(r.ids) == 4096 or r.used & (r.used - 1) == 0 for r in padded)
    assert packing.pack_documents(table(spark, []), path).count() == 0
    alike = packing.pack(packing.cut_pieces(table(spark, [(1, "same")] * 400).coalesce(1), path, 0), 16)
    assert alike.select(F.shiftright("sequence_id", 32)).distinct().count() > 8 and alike.count() == 400


def test_telephony_tables():
    assert audio.MULAW[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(audio.STEPS) == 89


def test_adpcm_against_a_scalar_decoder():
    rng = random.Random(1)
    blocks = np.array([[rng.randrange(256) for _ in range(audio.BLOCK)] for _ in range(7)], np.uint8)
    got = audio.decode_blocks(blocks)
    for row, out in zip(blocks.tolist(), got.tolist()):
        value, index = struct.unpack("<h", bytes(row[:2]))[0], min(row[2], 88)
        want = [value]
        for byte in row[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value + (-change if code & 8 else change)))
                index = max(0, min(88, index + int(audio.INDEX[code])))
                want.append(value)
        assert out == want


def test_media_round_trip(spark):
    texts = [None, "", "é" * 575, "abc" * 192, "x" * 100000, "x" * 100000]
    rows = spark.createDataFrame([(i, (t or "").encode()) for i, t in enumerate(texts)], "doc_id long, payload binary")
    got = {r.doc_id: r for r in audio.read(audio.store(rows, codec_of)).collect()}
    for i, t in enumerate(texts):
        want = audio.padded((t or "").encode())
        assert got[i].payload == want and len(want) % 576 == 0 and len(want) >= 576
        assert got[i].media[got[i].media.index(b"data") + 8 :] == want
        samples = {"adpcm": len(want) // audio.BLOCK * 377}.get(got[i].codec, len(want))
        assert len(got[i].pcm) == 4 * samples
    assert got[4].pcm == got[5].pcm
    assert {codec_of(bytes([i]) * 576) for i in range(40)} == {"mulaw", "alaw", "adpcm"}
    assert audio.read(audio.store(rows.limit(0), codec_of)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=40), st.sampled_from(["any", "mulaw", "alaw"]), st.booleans())
def test_packed_pcm_round_trip(values, kind, doubled):
    pcm = np.array(values, np.int16)
    if kind != "any":
        pcm = {"mulaw": audio.MULAW, "alaw": audio.ALAW}[kind][pcm & 255]
    if doubled:
        pcm = audio.resample(pcm)
    packed = audio.pack_pcm(pcm)
    assert (audio.unpack_pcm(packed) == pcm).all()
    if doubled and kind != "any":
        assert len(packed) == 9 + len(pcm) // 2


def g711_level(code: int, law: str) -> int:
    """A companded code by the definition of its law."""
    if law == "mulaw":
        code = ~code & 255
        size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
        return -4 * size if code & 128 else 4 * size
    code ^= 0x55
    part, low = code >> 4 & 7, code & 15
    size = (2 * low + 1 if part == 0 else (2 * low + 33) << (part - 1)) * 8
    return size if code & 128 else -size


def test_companding_tables_by_definition():
    assert audio.MULAW.tolist() == [g711_level(c, "mulaw") for c in range(256)]
    assert audio.ALAW.tolist() == [g711_level(c, "alaw") for c in range(256)]


def brute_windows(rows, width):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.add(k)
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("block_chars", [2000, 10**9])
def test_substrings(spark, block_chars):
    rng = random.Random(2)
    base = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(6)]
    rows = [(i, " ".join([rng.choice(base)[: rng.randrange(1, 300)], rng.choice(base), *rng.choices(WORDS, k=5)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a " * 5000), (None, base[0]), (3, base[1]), (103, base[2]), (104, base[2]), (105, "  one")]
    got = substrings.find_and_cut(table(spark, rows), 20, block_chars).collect()
    assert Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.text) for r in got) == brute_windows(rows, 20)
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))  # maximal: never adjacent


def test_equal_runs_need_both_hashes():
    rng = np.random.default_rng(12)
    first, second = rng.integers(0, 9, 300).astype(np.uint64), rng.integers(0, 3, 300).astype(np.uint16)
    order, same = substrings.equal_runs(first, second)
    kinds = [(int(first[i]), int(second[i])) for i in order]
    assert same.tolist() == [a == b for a, b in zip(kinds, kinds[1:])] and len(set(kinds)) == 300 - same.sum()
    assert all(a < b for a, b, s in zip(order, order[1:], same) if s)


def test_substrings_empty_table(spark):
    assert substrings.find_and_cut(table(spark, [])).count() == 0


def brute_components(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[find(i)].append(d)
    name = lambda i: min((d for d in names[find(i)] if d is not None), default=None) if sets[i] else rows[i][0]
    return Counter((d, len(sets[i]), name(i)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, percent):
    """A chain of near copies, a group about one base with members too far from it, copies, and short texts."""
    rng = random.Random(3)
    rows, base = [], [rng.choice(WORDS) for _ in range(120)]
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    w = [rng.choice(WORDS) for _ in range(100)]
    for i in range(20):
        w[(7 * i) % 100] = f"new{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "One"), (303, "one"), (304, "one two"), (305, "a b c"), (306, "A B C a b c"), (None, rows[3][1]), (7, rows[8][1]), (307, " ".join(rng.choices(WORDS, k=8000)))]
    got = jaccard.near_groups(table(spark, rows), k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, percent)


def test_jaccard_components_that_share_passages(spark):
    """Groups of near copies that share long passages with other groups: their lists are much alike, and joined."""
    rng = random.Random(12)
    say = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    passages, rows = [say(40) for _ in range(5)], []
    for g in range(30):
        own = say(rng.randrange(20, 160))
        words = [w for p in rng.sample(passages, rng.randrange(1, 4)) for w in p] + own
        for _ in range(rng.randrange(1, 6)):
            w = list(words)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard.near_groups(table(spark, rows), 5, 80).collect()
    want = brute_components(rows, 5, 80)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want and 10 < len({k[2] for k in want}) < len(rows)


def test_jaccard_empty_table(spark):
    assert jaccard.near_groups(table(spark, [])).count() == 0


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
        bits = int(np.bitwise_count((jaccard.parity_sketch(x) ^ jaccard.parity_sketch(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_viterbi_against_one_document_at_a_time():
    rng = np.random.default_rng(5)
    scores = [rng.normal(0, 4, (n, 3)).astype(np.float32) for n in (1, 5, 40, 7, 40)]
    for s, got in zip(scores, langid.viterbi(scores, 3.0)):
        best = s[0].astype(float)
        back = []
        for row in s[1:]:
            jump = best.max() - 3.0
            back.append(np.where(best >= jump, np.arange(3), best.argmax()))
            best = np.maximum(best, jump) + row
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        total = lambda ls: sum(float(s[i, l]) for i, l in enumerate(ls)) - 3.0 * sum(a != b for a, b in zip(ls, ls[1:]))
        assert total(got.tolist()) == pytest.approx(total(labels[::-1]), abs=1e-3)


def test_language_id(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    make = lambda letters, n: " ".join(word(letters) for _ in range(n))
    kinds = {"aa": "abcde", "bb": "vwxyz", "ru": "абвгд"}
    rows = [(i, make(v, 40), k) for i, (k, v) in enumerate(list(kinds.items()) * 30)]
    odd = [(900, None, None), (901, "", "aa"), (902, "12 3.4 ½ _", "aa"), (903, make("abcde", 60) + " " + make("vwxyz", 60), None), (904, "авб", None), (905, "a" * 200000, None), (None, "vxyz wvxy", "bb")]
    model = langid.fit(table(spark, rows))
    got = {r.row.doc_id: r for r in langid.predict(table(spark, rows + odd), model).collect()}
    assert all(got[d].lang_pred == k and got[d].score > 0.9 for d, _, k in rows)
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and got[900].spans == []
    assert [s.lang for s in got[903].spans] == ["aa", "bb"] and got[904].lang_pred == "ru" and got[None].lang_pred == "bb"
    assert 0.4 < got[903].score < 0.6
    none = langid.fit(table(spark, []))
    assert {r.lang_pred for r in langid.predict(table(spark, rows[:3]), none).collect()} == {"und"}
    assert langid.predict(table(spark, []), model).count() == 0


def test_word_scores_against_one_word_at_a_time(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abcdeéжт") for _ in range(rng.randrange(1, 7))) for _ in range(30)), rng.choice(["xx", "yy", "zz"])) for i in range(60)]
    model = langid.fit(table(spark, rows))
    counts, scripts = {k: Counter() for k in ("xx", "yy", "zz")}, {k: Counter() for k in ("xx", "yy", "zz")}

    def grams(word):
        marked = f"<{word}>"
        return [marked[i : i + n] for n in (1, 2, 3) for i in range(len(marked) - n + 1) if n > 1 or marked[i] not in "<>"]

    numbers = {}
    for word in {w for _, t, _ in rows for w in t.lower().split()} | {"qq"}:
        places, _ = langid.features([word])
        got = sorted(places[places < langid.FEATURES].tolist())
        assert len(got) == len(grams(word))
        numbers[word] = got
    for _, text, lang in rows:
        for w in text.split():
            counts[lang].update(numbers[w])
            scripts[lang][langid.script(w)] += 1
    for word in [*list(numbers)[:40], "qq"]:
        raw = []
        for lang in model.languages:
            total = sum(counts[lang].values())
            raw.append(sum(np.log((counts[lang][g] + langid.SMOOTH) / (total + langid.SMOOTH * langid.FEATURES)) for g in numbers[word]))
        want = [max(x - max(raw), langid.RULED_OUT / 2) for x in raw]
        assert model.scores([word])[0].tolist() == pytest.approx(want, abs=1e-2)


def test_settled_texts_have_the_labels_of_viterbi():
    rng = np.random.default_rng(11)
    scores = [np.minimum(0, rng.normal(m, 2, (n, 3))).astype(np.float32) for n, m in zip(rng.integers(1, 60, 300), rng.choice([-1, -3], 300))]
    for s in scores[::2]:
        s[:, 1] = 0  # one language stands out
    for s in scores[::6]:
        s[: len(s) // 2] = [-9, 0, 0]
        s[len(s) // 2 :] = [0, -9, -9]
    labels = langid.viterbi(scores)
    known = langid.settled(np.concatenate(scores), np.array([len(s) for s in scores]))
    assert 50 < (known >= 0).sum() < 290
    for k, own in zip(known, labels):
        assert k < 0 or (own == k).all()


def test_words_and_their_places():
    texts = ["½cup ²a", "Ab-cd e1f İX", "", None, "12 ½", "ÜBER straße\nx", "´´"]
    words, codes, counts = langid.letter_words(pa.array(texts, pa.string()))
    assert counts.tolist() == [2, 5, 0, 0, 0, 3, 0]
    assert [words[c] for c in codes] == ["cup", "a", "ab", "cd", "e", "f", "ix", "über", "straße", "x"]
    for t in texts:
        found = [t[a:].lower() for a in langid.word_places(t or "").tolist()] if t else []
        assert all(x[0].isalpha() for x in found)
    assert langid.word_places("Ab-cd e1f İX").tolist() == [0, 3, 6, 8, 10]


def test_token_files(spark, encoders):
    path, e = tokenizer_path("word_bpe_49k.json"), encoders["word_bpe_49k.json"]
    rng = random.Random(7)
    rows = [(i * 3, " ".join(rng.choices(["Cat", "dog,", "naïve", "42"], k=i % 50))) for i in rng.sample(range(400), 400)] + [(2000, None), (2001, ""), (2002, "long " * 80000), (None, "x y"), (6, "b"), (6, "a")]
    manifest = tokenfile.write_documents(table(spark, rows), path, 1, chars_per_file=100_000)
    assert manifest.count() > 1 and manifest.agg(F.sum("docs")).first()[0] == len(rows)
    got = sorted(tokenfile.read_files(manifest).collect(), key=lambda r: r.start)
    at = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (d, t) in zip(got, order, strict=True):
        ids = e.encode_whole(t or "") + [1]
        assert (r.doc_id, r.start) == (d, at) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    some = tokenfile.read_files(manifest, [9, 2002, 7]).collect()
    assert sorted(r.doc_id for r in some) == [9, 2002]
    none = tokenfile.write_documents(table(spark, []), path)
    assert none.count() == 0 == tokenfile.read_files(none).count()
    files = spark.createDataFrame([(i, 10 * i + 1) for i in range(25)], "part long, tokens long")
    assert {r.part: r.start for r in tokenfile.with_starts(files, block=4).collect()} == {i: sum(10 * k + 1 for k in range(i)) for i in range(25)}


def test_reader_fetches_only_what_is_asked_and_finds_damage():
    out = io.BytesIO()
    w = tokenfile.FrameWriter(out)
    for i in range(40):
        w.add(i, np.full(20_000, i, "<u4").tobytes())
    w.close()
    data = out.getvalue()

    class File(io.BytesIO):
        fetched = 0

        def size(self):
            return len(data)

        def read(self, n=-1):
            File.fetched += n
            return super().read(n)

    (row,) = tokenfile.FrameReader(File(data)).documents([17])
    assert row[0] == 17 and zlib.crc32(row[2]) == zlib.crc32(np.full(20_000, 17, "<u4").tobytes())
    assert File.fetched < len(data) / 2
    broken = bytearray(data)
    broken[30] ^= 255
    with pytest.raises(Exception):
        list(tokenfile.FrameReader(File(bytes(broken))).documents())
    assert hashlib.sha256(data).digest()
