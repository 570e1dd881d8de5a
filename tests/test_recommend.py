"""The best postings of many candidates against all pairs."""

import random

from postmill.operators import recommend


def test_top_postings_against_all_pairs(spark):
    rng = random.Random(2)
    skills = [f"s{i}" for i in range(30)]
    sets = [rng.choices(skills, k=rng.randrange(1, 6)) for _ in range(60)] + [[]]
    jobs = [(i, rng.choice(sets)) for i in range(3000)]
    candidates = [(i, rng.choices(skills, k=rng.randrange(0, 9))) for i in range(1000)]
    top, work = recommend.top_postings(spark.createDataFrame(jobs, "job_id long, skills array<string>"), spark.createDataFrame(candidates, "profile_id long, skills array<string>"), 20)
    got = {}
    for r in top.collect():
        got.setdefault(r.profile_id, {})[r.place] = (r.job_id, round(r.required_score, 6))
    for c, own in candidates:
        scores = ((j, round(len({*own} & {*s}) / len({*s}) * 100, 6)) for j, s in jobs if {*own} & {*s})
        want = sorted(scores, key=lambda x: (-x[1], x[0]))[:20]
        assert got.get(c, {}) == {i: w for i, w in enumerate(want, 1)}
    assert work.first()[0] < 0.02 * len(jobs) * len(candidates)


def test_candidates_of_equal_skills_are_scored_once(spark):
    jobs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"])], "job_id long, skills array<string>")
    candidates = spark.createDataFrame([(i, ["b", "a"] if i % 2 else ["a", "b", "a"]) for i in range(50)], "profile_id long, skills array<string>")
    top, work = recommend.top_postings(jobs, candidates, 5)
    assert sorted((r.profile_id, r.place, r.job_id) for r in top.collect()) == [(i, p, j) for i in range(50) for p, j in ((1, 1), (2, 2))]
    assert work.first()[0] == 2
