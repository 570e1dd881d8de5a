"""The stored table, the match cache and stored ingestion: writers in turn, crashes, replays, stale rows."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import evaluation, keyed
from postmill.sources.snapshots import Conflict, Store


def put(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def upsert(old, new):
    return keyed.upsert(old, new, "k").drop("action")


@pytest.fixture
def store(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "store"), put(spark, []).schema, ["k"], n_buckets=8)
    assert s.read().count() == 0
    s.merge(put(spark, [(i, "first") for i in range(40)]), upsert)
    return s


def test_merge_rewrites_only_touched_buckets(spark, store):
    before = store.manifest()
    store.merge(put(spark, [(3, "second"), (900, "new")]), upsert)
    after = store.manifest()
    moved = {b for b in after.buckets if after.buckets[b] != before.buckets.get(b)}
    assert 1 <= len(moved) <= 2 and len(after.buckets) == 8
    assert {r.k: r.v for r in store.read().collect()} == {i: "first" for i in range(40)} | {3: "second", 900: "new"}
    assert {r.v for r in store.read(before).collect()} == {"first"}  # a reader keeps its snapshot


def test_writer_killed_before_the_rename_changes_nothing(spark, store):
    class Killed(Exception):
        pass

    def die():
        raise Killed

    with pytest.raises(Killed):
        store.merge(put(spark, [(1, "lost")]), upsert, before_commit=die)
    assert {r.v for r in store.read().collect()} == {"first"} and store.versions() == [0, 1]
    store.merge(put(spark, [(1, "kept")]), upsert)
    assert store.read().filter("k = 1").first().v == "kept"


def test_two_writers_of_one_version(spark, store):
    base = store.manifest()
    store.merge(put(spark, [(1, "a")]), upsert, base=base)
    with pytest.raises(Conflict):
        store.merge(put(spark, [(2, "b")]), upsert, base=base)
    store.merge(put(spark, [(2, "b")]), upsert)
    assert {r.k: r.v for r in store.read().filter("k < 3").collect()} == {0: "first", 1: "a", 2: "b"}


def test_a_marked_batch_is_merged_once(spark, store):
    add = lambda old, new: keyed.upsert(old, new, "k").drop("action").withColumn("v", F.concat("v", F.lit("+")))
    assert store.merge(put(spark, [(1, "x")]), add, mark=("s", 4))
    assert not store.merge(put(spark, [(1, "x")]), add, mark=("s", 4))
    assert store.read().filter("k = 1").first().v == "x+"


def test_a_repeated_key_is_one_row(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k long, v string, at int")
    new = spark.createDataFrame([(1, "b", 5), (1, "c", 3), (2, None, None), (2, "d", None)], "k long, v string, at int")
    assert {tuple(r) for r in keyed.upsert(old, new, "k", latest=["at"], by="at").collect()} == {(1, "b", 5, "updated"), (2, "d", None, "inserted")}


def test_cache_of_several_candidates(spark):
    jobs = spark.createDataFrame([(1, "j1"), (2, "j1"), (3, None)], "job_id long, job_version string")
    asked = jobs.withColumn("profile_id", F.explode(F.array(F.lit(1), F.lit(2))))
    cache = spark.createDataFrame([
        (1, 1, "j1", 11.0, 5), (1, 2, "j1", 22.0, 5),  # both candidates have the posting
        (2, 1, "j1", 33.0, 1), (2, 1, "j0", 44.0, 2),  # an older row has the right version, the newest does not
        (2, 2, "j0", 55.0, 1), (2, 2, "j1", 66.0, 2), (3, 2, None, 77.0, 1),
    ], "job_id long, profile_id int, job_version string, overall_score double, calculated_at int")
    for rows in (cache, cache.orderBy(F.desc("calculated_at"), F.desc("overall_score"))):
        got = keyed.cached_or_missing(asked, rows, ["job_id", "profile_id"], ["job_version"], ["calculated_at"], ["overall_score"]).collect()
        assert {(r.job_id, r.profile_id): (r.hit, r.overall_score) for r in got} == {
            (1, 1): (True, 11.0), (1, 2): (True, 22.0), (2, 1): (False, None), (2, 2): (True, 66.0), (3, 1): (False, None), (3, 2): (True, 77.0),
        } and len(got) == 6


def test_misses_are_stored_and_hit_next_time(spark, tmp_path):
    from postmill.plans import matching
    from postmill.plans.standins import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    jobs = matching.jobs(t).limit(60).cache()
    none = matching.cached_matches(t).limit(0)
    store = Store.create(spark, str(tmp_path / "cache"), none.schema, evaluation.KEYS, n_buckets=4)
    first = evaluation.evaluate_cached(jobs, matching.TWO, store.read(), **matching.HOW)
    evaluation.store_misses(store, first, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    again = evaluation.evaluate_cached(jobs, matching.TWO, store.read(), **matching.HOW).collect()
    assert len(again) == 120 and all(r.hit for r in again)
    want = {(r.job_id, r.profile_id): r.overall_score for r in first.collect()}
    assert {(r.job_id, r.profile_id): r.overall_score for r in again} == want
    other = [matching.evaluation.Candidate(**(c.__dict__ | {"preference_version": "2"})) for c in matching.TWO]
    assert not any(r.hit for r in evaluation.evaluate_cached(jobs, other, store.read(), **matching.HOW).select("hit").collect())


class Killed(Exception):
    pass


def postings(n):
    """Raw postings of one file: repeats over files and sources, a bad URL, old and undated ones, a source that fails once."""
    rows = []
    for i in range(30):
        k = (i * 7 + n * 5) % 40
        failed = i % 10 == 9 and n != 2
        rows.append((f"h{k:02d}", "abc"[i % 3] if not failed else "down", "ftp://x" if i == 4 else f"https://x/{k % 33}", f"title {k} {n}", "firm", None if i % 4 else float(n), None if i == 5 else f"2024-01-{1 + (i * n) % 28:02d} 00:00:00", "Timed out" if failed else None, None))
    return rows


RAW = "job_hash string, source string, source_url string, title string, company_name string, salary_max double, posted_at string, error string, status_code int"


@pytest.mark.parametrize("stage", ["before", "after"])
def test_stream_killed_and_restarted_gives_the_undisturbed_table(spark, tmp_path, stage):
    from postmill.streaming import ingest

    files = tmp_path / "in"
    for n in range(3):
        spark.createDataFrame(postings(n), RAW).coalesce(1).write.mode("append").json(str(files))
    oldest, bad = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), F.when(~F.col("source_url").rlike("^https?://"), "bad_url")
    prepare = lambda b: b.withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))

    def run(name, **hooks):
        store = Store(spark, str(tmp_path / name)) if (tmp_path / name).exists() else ingest.create(spark, str(tmp_path / name), 4)
        rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(files))
        ingest.run(rows, store, str(tmp_path / f"{name}-state"), prepare, oldest, bad, **hooks)
        return store

    calm = run("calm")
    seen = []

    def die(number):
        seen.append(number)
        if number == 1 and seen.count(1) == 1:
            raise Killed

    with pytest.raises(Exception):
        run("torn", **{f"{stage}_commit": die})
    torn = run("torn", **{f"{stage}_commit": die})
    assert seen.count(1) == 2 if stage == "after" else seen.count(1) >= 2  # the batch came again
    same = lambda s: [sorted(map(repr, (tuple(r) for r in df.collect()))) for df in (s.read(), s.side("report", ingest.REPORT), s.side("rejects", ingest.REJECTS), s.side("told", ingest.TOLD))]
    assert same(torn) == same(calm) and all(same(calm))
    told = [r.job_hash for r in calm.side("told", ingest.TOLD).collect()]
    assert len(told) == len(set(told)) == calm.read().count()
    status = {(r.batch, r.source): (r.status, r.error_category) for r in calm.side("report", ingest.REPORT).collect()}
    assert sum(s == ("failed", "transient_network") for s in status.values()) == 2 and {s for s, _ in status.values()} == {"success", "failed"}
    assert sorted(r.status for r in ingest.overall(calm.side("report", ingest.REPORT)).collect()) == ["partial_success", "partial_success", "success"]
    assert sum(r.discovered for r in calm.side("report", ingest.REPORT).collect()) == sum(not r[7] for n in range(3) for r in postings(n))


def test_scratch_removes_its_tables(spark):
    from postmill.operators.tables import cut_lineage, scratch

    outside = cut_lineage(spark.range(3))
    with scratch(spark):
        inside = cut_lineage(spark.range(5))
        with scratch(spark):
            assert cut_lineage(spark.range(2)).count() == 2
        assert inside.count() == 5
    assert outside.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inside.inputFiles()[0])
