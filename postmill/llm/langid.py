"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed text.

Fitting counts hashed character 1- to 3-grams of words per language over all labelled rows (a table of FEATURES rows
per language, whatever the input) and how often a language's words are in each script. A word is a run of letters,
lower-cased code point by code point; Arrow finds the words, and each distinct one of a slice is scored once. A word's
score for a language is its n-grams' summed log probability; languages that the word's script rules out get a fixed low
score. Viterbi then finds the labels with the highest sum of word scores less SWITCH for every change of language. Most
texts have one language throughout: a bound on what any change could gain (``settled``) proves it for all texts of a
slice at once; the others take their steps together. The label of a document is the language of most of its letters,
the score that share.

Defined cases: null text or a text without a letter is ``und`` with score 0, no letters and no span; when no row is
labelled everything is ``und``; a numeral or mark beside letters parts words and is no letter; of more than LANGUAGES
labels those of most rows are learned; ties go to the first language by name; a script that no language was seen in
narrows nothing; rows are judged one by one, so repeated rows agree; an empty table gives no rows; the columns to carry
travel in one struct and can clash with nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .tokens import slices

FEATURES = 1 << 16
SWITCH = 12.0
#: A language is a candidate for a script that at least this share of its words is in.
SCRIPT_SHARE = 0.002
RULED_OUT = -60.0
SMOOTH = 0.1
#: Most labels that are learned.
LANGUAGES = 256
#: Bytes of text that are held as words at a time, words that wait for Viterbi, and words whose scores a task remembers.
SLICE, WAITING, REMEMBERED = 2_000_000, 1_000_000, 200_000

#: First code points of script ranges and their scripts, fixed values.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_EDGES = [e for e, _ in SCRIPTS]
NAMES = sorted({s for _, s in SCRIPTS})


def letter_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, the number of every word in order, and words per text. Letters are looked for in distinct tokens only."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    tokens = lists.flatten().dictionary_encode()
    codes = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(tokens.dictionary), r"\P{L}+", " "))
    parts = pc.split_pattern(plain, " ")
    # A token without a letter gives one empty part and counts for no word.
    sizes = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, np.diff(parts.offsets.to_numpy()))
    words = parts.flatten().dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = parts.offsets.to_numpy()[:-1].astype(np.int64)
    counts = sizes[codes]
    ends = np.cumsum(counts)
    every = numbers[np.repeat(firsts[codes] - (ends - counts), counts) + np.arange(int(counts.sum()))]
    edges = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
    return words.dictionary.to_pylist(), every, np.diff(edges).astype(np.int64)


def word_places(text: str) -> np.ndarray:
    """Where each word starts, in code points; lower-casing keeps places."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pa.scalar(text)), r"\P{L}", " ").as_py()
    letter = np.frombuffer(plain.encode("utf-32-le"), "<u4") != 32
    return np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_EDGES, ord(word[0])) - 1][1]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of all words within edge marks: (places, 3) numbers, FEATURES for none; first place of each word."""
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(c))  # characters from here to the word's end
    first = np.zeros(len(c), bool)
    first[starts] = True
    after = np.concatenate([c[1:], np.zeros(1, np.uint64)])
    third = np.concatenate([c[2:], np.zeros(2, np.uint64)])[: len(c)]
    out = np.full((len(c), 3), FEATURES, np.int64)
    for k, (value, there) in enumerate(((c, ~first & (left > 1)), (c << np.uint64(21) | after, left > 1), (c << np.uint64(42) | after << np.uint64(21) | third, left > 2))):
        h = (value + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[there, k] = (h >> np.uint64(40))[there].astype(np.int64) & (FEATURES - 1)
    return out, starts


def count_features(docs: DataFrame) -> DataFrame:
    """docs: text, lang (both non-null) -> lang, kind ('gram' or a script), feature, n: sums over all rows."""
    ship(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch.column("text"), SLICE):
                words, codes, counts = letter_words(batch.column("text")[part.start : part.stop])
                label = batch.column("lang")[part.start : part.stop].dictionary_encode()
                own = np.repeat(label.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
                times = np.bincount(own * len(words) + codes, minlength=len(label.dictionary) * len(words)).reshape(-1, len(words))
                places, starts = features(words)
                written = [script(w) if w else "other" for w in words]
                for lang, n in zip(label.dictionary.to_pylist(), times):
                    table = grams.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                    weights = np.repeat(n, np.diff(starts, append=len(places)))
                    table += np.bincount(places.ravel(), np.repeat(weights, 3), FEATURES + 1).astype(np.int64)
                    seen = scripts.setdefault(lang, Counter())
                    for k in np.flatnonzero(n).tolist():
                        seen[written[k]] += int(n[k])
        for lang, table in grams.items():
            at = np.flatnonzero(table[:FEATURES])
            names = list(scripts[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + len(names)), pa.string()), pa.array(["gram"] * len(at) + names, pa.string()), pa.array([*at.tolist(), *[0] * len(names)], pa.int32()), pa.array([*table[at].tolist(), *(scripts[lang][s] for s in names)], pa.int64())], schema=schema)

    rows = docs.select("text", "lang").mapInArrow(tidy(run), "lang string, kind string, feature int, n long")
    return rows.groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))


class Model:
    """languages by name; log (FEATURES, languages) of float32; allowed: script -> mask of languages."""

    def __init__(self, counts: pa.Table):
        langs = np.array(counts.column("lang").to_pylist(), object)
        kinds = np.array(counts.column("kind").to_pylist(), object)
        self.languages = sorted(set(langs.tolist()))
        table = np.zeros((FEATURES, len(self.languages)))
        shares = {}
        n, feature = counts.column("n").to_numpy(), counts.column("feature").to_numpy()
        for k, lang in enumerate(self.languages):
            own = langs == lang
            gram = own & (kinds == "gram")
            table[feature[gram], k] = n[gram]
            total = n[own & ~gram].sum()
            for s, c in zip(kinds[own & ~gram], n[own & ~gram]):
                shares.setdefault(s, np.zeros(len(self.languages)))[k] = c / max(1, total)
        log = np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * FEATURES)).astype(np.float32)
        self.log = np.concatenate([log, np.zeros((1, len(self.languages)), np.float32)])  # the last row: no feature
        self.allowed = {s: x >= SCRIPT_SHARE for s, x in shares.items() if (x >= SCRIPT_SHARE).any()}

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): relative to the best language, so that sums stay small and one odd word can't outweigh a text."""
        if not words:
            return np.empty((0, len(self.languages)), np.float32)
        places, starts = features(words)
        at_place = self.log[places[:, 0]] + self.log[places[:, 1]] + self.log[places[:, 2]]
        score = np.add.reduceat(at_place, starts, axis=0)
        score = np.maximum(score - score.max(1, keepdims=True), np.float32(RULED_OUT / 2))
        everyone = np.ones(len(self.languages), bool)
        mask = np.array([self.allowed.get(script(w), everyone) if w else everyone for w in words])
        return np.where(mask, score, np.float32(RULED_OUT))


def fit(docs: DataFrame, languages: int = LANGUAGES) -> Model:
    """From docs' text and lang alone; the result's size is set by FEATURES and languages."""
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    return Model(count_features(labelled.filter(F.col("lang").isin([r["lang"] for r in most]))).toArrow())


def settled(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """scores (words, languages) of texts with counts words, one at least: the language of a text whose best labels never change, else -1.

    Against the best single language, let ``most`` be the largest gain of any stretch labelled otherwise, and ``edges``
    the largest gains at the start and at the end together. A change costs ``switch`` and a stretch within costs two, so
    with most and edges below switch no set of stretches pays.
    """
    starts = np.cumsum(counts) - counts
    totals = np.add.reduceat(scores, starts, axis=0, dtype=np.float64)
    best = totals.argmax(1)
    gain = scores - np.take_along_axis(scores, np.repeat(best, counts)[:, None], 1)
    run = np.cumsum(gain, axis=0, dtype=np.float64)
    run -= np.repeat(np.concatenate([np.zeros((1, run.shape[1])), run[starts[1:] - 1]]), counts, axis=0)
    apart = np.repeat(np.arange(len(counts)) * (1.0 + np.ptp(run)), counts)[:, None]  # a text's values lie below those of the text before it
    low = np.minimum(np.minimum.accumulate(run - apart, axis=0) + apart, 0)
    most = np.maximum.reduceat((run - low).max(1), starts)
    first = np.maximum.reduceat(run.max(1), starts)
    last = (run[starts + counts - 1] - low[starts + counts - 1]).max(1)
    second = np.sort(totals, axis=1)[:, -2] if totals.shape[1] > 1 else np.full(len(counts), -np.inf)
    slack = 1e-2  # sums are rounded, and ties go the long way
    sure = (np.maximum(most, np.maximum(first, 0) + np.maximum(last, 0)) < switch - slack) & (totals.max(1) - second > slack)
    return np.where(sure, best, -1)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """scores: per document (words, languages), each with a word or more -> the best labels of each."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    total = int(lengths.sum())
    # Step-major: step t holds word t of all documents that have one, longest first.
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left") if total else np.empty(0, int)
    base = np.concatenate([[0], np.cumsum(active)])
    flat = np.concatenate([scores[i] for i in order])
    step = np.concatenate([np.arange(n) for n in lengths])
    rank = np.repeat(np.arange(len(order)), lengths)
    place = base[step] + rank
    by_step = np.empty_like(flat)
    by_step[place] = flat
    stay = np.ones(flat.shape, bool)
    best_before = np.zeros(total, np.int16)
    value = by_step[: active[0]].copy()
    ends = np.zeros(len(order), np.int16)
    for t in range(1, len(active)):
        n, a = active[t], base[t]
        if n < len(value):
            ends[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        top = value.argmax(1)
        jump = value[np.arange(n), top] - switch
        keep = value >= jump[:, None]
        stay[a : a + n] = keep
        best_before[a : a + n] = top
        value = np.where(keep, value, jump[:, None]) + by_step[a : a + n]
    ends[: len(value)] = value.argmax(1)
    labels = np.empty(total, np.int16)
    now = ends.copy()
    for t in range(len(active) - 1, -1, -1):
        n, a = active[t], base[t]
        labels[a : a + n] = now[:n]
        if t:
            held = now[:n]
            now[:n] = np.where(stay[a : a + n][np.arange(n), held], held, best_before[a : a + n])
    own = labels[place]
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(order)
    for i, part in zip(order, np.split(own, np.cumsum(lengths)[:-1])):
        out[i] = part
    return out


class Labeller:
    """Judges texts with a model; remembers word scores within a task."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.table = np.empty((1024, len(model.languages)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.row) > REMEMBERED:
            self.row = {}
        known = self.row
        new = [w for w in words if w not in known]
        if new:
            end = len(known) + len(new)
            if end > len(self.table):
                self.table = np.concatenate([self.table[: len(known)], np.empty((end - len(known) + 50_000, self.table.shape[1]), np.float32)])
            self.table[len(known) : end] = self.model.scores(new)
            known.update(zip(new, range(len(known), end)))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def judge(self, texts: pa.Array, with_spans: bool = True, most: int = SLICE) -> tuple[list[str], list[float], list[int], list[list[dict]]]:
        """Language, score, letters and spans of every text."""
        n, languages = len(texts), self.model.languages
        lang, score, letters, spans = ["und"] * n, [0.0] * n, [0] * n, [[] for _ in range(n)]
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0

        def settle() -> None:
            nonlocal waiting, held
            for (i, _, sizes), labels in zip(waiting, viterbi([x[1] for x in waiting]) if waiting else ()):
                share = np.bincount(labels, sizes, len(languages))
                lang[i], score[i] = languages[int(share.argmax())], float(share.max() / share.sum())
                if with_spans:
                    spans[i] = spans_of(languages, texts[i].as_py(), labels)
            waiting, held = [], 0

        for part in slices(texts, most):
            words, codes, counts = letter_words(texts[part.start : part.stop])
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            counts = counts[some]
            sizes = np.fromiter(map(len, words), np.int64, len(words))[codes]
            starts = np.cumsum(counts) - counts
            some = (some + part.start).tolist()
            for i, size in zip(some, np.add.reduceat(sizes, starts).tolist()):
                letters[i] = size
            if not languages:
                continue
            scores = self.scores(words)[codes]
            for i, label, a, count in zip(some, settled(scores, counts).tolist(), starts.tolist(), counts.tolist()):
                if label < 0:
                    waiting.append((i, scores[a : a + count].copy(), sizes[a : a + count].copy()))
                    held += count
                else:
                    lang[i], score[i] = languages[label], 1.0
                    if with_spans:
                        spans[i] = [{"start": 0, "end": len(texts[i].as_py()), "lang": lang[i]}]
            if held > WAITING:
                settle()
        settle()
        return lang, score, letters, spans


def spans_of(languages: list[str], text: str, labels: np.ndarray) -> list[dict]:
    """Maximal stretches of one language, in characters of the text."""
    turns = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *(word_places(text)[turns].tolist() if len(turns) else ()), len(text)]
    return [{"start": a, "end": b, "lang": languages[int(labels[k])]} for a, b, k in zip(edges, edges[1:], [0, *turns])]


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None, with_spans: bool = True) -> DataFrame:
    """row (struct of the columns to carry, by default all), lang_pred, score, letters (their number) and, if asked for, spans. A text travels once."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carry = docs.columns if carry is None else carry
    within = "text" in carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *[] if within else ["text"])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    most = max(50_000, 8 * SLICE // max(8, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            row = batch.column("row")
            lang, score, letters, spans = labeller.judge(row.field("text") if within else batch.column("text"), with_spans, most)
            found = {"row": row, "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "letters": pa.array(letters, pa.int64())}
            yield pa.RecordBatch.from_pydict(found | ({"spans": pa.array(spans, spans_type)} if with_spans else {}))

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"row {kind}, lang_pred string, score double, letters long" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans)
