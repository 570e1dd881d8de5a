"""Names in texts: the trie against one pattern per alias, the join against brute force, and a dictionary of 100,000 names."""

import random
import re

from pyspark.sql import functions as F

from postmill.functions import skills
from postmill.operators import dictionary


def by_patterns(text, aliases):
    """Canonical names by place: every alias tried by itself, a longer one takes its span first."""
    spans = []
    for alias, name in sorted(aliases.items(), key=lambda x: -len(x[0])):
        edge = (r"\b", r"\b") if re.fullmatch(r"[a-zA-Z0-9\s]+", alias) else ("(?<![a-zA-Z0-9])", "(?![a-zA-Z0-9])")
        for m in re.finditer(edge[0] + re.escape(alias) + edge[1], text, re.IGNORECASE):
            if not any(s <= m.start() < e or s < m.end() <= e for s, e, _ in spans):
                spans.append((*m.span(), name))
    names = {}
    for *_, name in sorted(spans):
        names.setdefault(name.lower(), name)
    return list(names.values())


def test_trie_finds_what_patterns_find():
    rng, trie = random.Random(3), skills.Trie(skills.ALIASES)
    glue = [" ", " ", " ", ", ", "/", "-", ".", "_", "é", "", "\n", "3", "++", "  "]
    for _ in range(1500):
        text = "".join(rng.choice([*skills.ALIASES, "word", "Java", "REACT"]).title() * (rng.random() < 0.9) + rng.choice(glue) for _ in range(rng.randrange(0, 14)))
        assert trie.skills_in(text) == by_patterns(text, skills.ALIASES), text
    assert trie.skills_in(None) == []


def brute_matches(text, aliases):
    words = re.findall(r"[^\s,;:/|()\[\]{}]+", (text or "").lower())
    out, i = [], 0
    while i < len(words):
        n = max((n for n in range(1, 9) if i + n <= len(words) and tuple(words[i : i + n]) in aliases), default=0)
        if n:
            out.append((i, n, aliases[tuple(words[i : i + n])]))
        i += n or 1
    return out


def test_longest_matches_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["a", "b", "c", "New", "delhi", "x.y", "c++"]
    say = lambda n: rng.choice([" ", ", ", " / "]).join(rng.choices(pool, k=n))
    names = [(say(rng.randrange(1, 4)), f"v{i}") for i in range(25)] + [(None, "v"), ("  ", "v")]
    aliases = {}
    for alias, value in names:
        ws = tuple(re.findall(r"[^\s,;:/|()\[\]{}]+", (alias or "").lower()))
        aliases[ws] = min(value, aliases.get(ws, value))
    aliases.pop((), None)
    texts = [(i, say(rng.randrange(0, 40))) for i in range(80)] + [(90, None), (91, ""), (92, "a " * 900)]
    got = dictionary.longest_matches(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(names, "alias string, value string")).collect()
    assert sorted((r.id, r.first, r.n, r.value) for r in got) == sorted((i, *m) for i, t in texts for m in brute_matches(t, aliases)) and len(got) > 300
    assert dictionary.longest_matches(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([], "alias string, value string")).count() == 0


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("place "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " north").otherwise("")).alias("alias"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("value"))
    texts = spark.createDataFrame([(1, "From Place 99999 north, place 7; place 3"), (2, "nowhere")], "id long, text string")
    found = dictionary.longest_matches(texts, "id", "text", names)
    assert {(r.id, r.first, r.value) for r in found.collect()} == {(1, 1, "P99999"), (1, 4, "P7")}
    assert "place 77" not in found._jdf.queryExecution().toString()
