"""Queries of the feed: filters, joins, facets, ranking, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, places, profile, times, titles
from ..operators import facets, filters, keyed
from .registry import query
from .standins import EVENTS_NOW, NOW, Tables, clock

#: A window that some of the stand-in's postings, seven years of them, fall into.
HOURS = 24 * 400
FRESH = f"is_active AND posted_at IS NOT NULL AND posted_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR AND posted_at_confidence IN ('HIGH', 'MEDIUM') AND source <> 'sample'"


@query(f"SELECT job_id, source, posted_at FROM postings WHERE {FRESH}", "postings")
def f1_freshness_gate(t: Tables) -> DataFrame:
    return t.postings.filter(filters.fresh(clock(NOW), HOURS)).select("job_id", "source", "posted_at")


@query("SELECT source, count(*) AS n FROM postings WHERE source = 'west' GROUP BY source", "postings")
def f2_source_filter(t: Tables) -> DataFrame:
    return t.postings.filter(filters.from_source("west") & filters.from_source("all")).groupBy("source").agg(F.count("*").alias("n"))


@query(
    """SELECT job_id,
      coalesce(experience_min = 0 OR employment_type = 'INTERNSHIP' OR (experience_min IS NULL AND (experience_max IS NULL OR experience_max <= 1)), false) AS fits_0,
      coalesce(experience_min <= 2 OR (experience_min IS NULL AND experience_max <= 2) OR (experience_min IS NULL AND experience_max IS NULL) OR employment_type = 'INTERNSHIP', false) AS fits_2
    FROM postings""",
    "postings",
)
def f3_experience_filter(t: Tables) -> DataFrame:
    return t.postings.select("job_id", filters.experience_at_most(0).alias("fits_0"), filters.experience_at_most(2).alias("fits_2"))


@query(
    "SELECT job_id FROM postings WHERE experience_max >= 3 OR (experience_max IS NULL AND experience_min >= 3) OR experience_min >= 3 OR (experience_min IS NULL AND experience_max IS NULL)",
    "postings",
)
def f4_experience_floor(t: Tables) -> DataFrame:
    return t.postings.filter(filters.experience_at_least(3)).select("job_id")


@query("SELECT remote_type, count(*) AS n FROM postings WHERE remote_type <> 'REMOTE' GROUP BY remote_type", "postings")
def f5_exclude_remote(t: Tables) -> DataFrame:
    return t.postings.filter(filters.not_remote()).groupBy("remote_type").agg(F.count("*").alias("n"))


@query("SELECT job_id, title FROM postings WHERE contains(lower(concat_ws(' ', title, description)), 'docker')", "postings")
def f6_keyword(t: Tables) -> DataFrame:
    return t.postings.filter(filters.keyword("Docker", F.col("title"), F.col("description"))).select("job_id", "title")


@query(
    r"""SELECT title, count(*) AS n FROM postings WHERE regexp_matches(regexp_replace(lower(title), '[/_-]', ' ', 'g'),
        'backend|back end|api developer|server engineer|python developer|python engineer|node developer|django developer|fastapi developer')
        OR contains(lower(title), 'back-end') GROUP BY title""",
    "postings",
)
def f7_target_role(t: Tables) -> DataFrame:
    return t.postings.filter(titles.matches_target_role(F.col("title"), ["Backend Engineer"])).groupBy("title").agg(F.count("*").alias("n"))


@query(
    r"SELECT job_id FROM postings WHERE NOT (coalesce(salary_min = 0 AND salary_max = 0, false) OR coalesce(contains(lower(salary_raw), 'unpaid'), false))",
    "postings",
)
def f9_paid_only(t: Tables) -> DataFrame:
    return t.postings.filter(filters.paid()).select("job_id")


@query(
    "SELECT company_name, count(*) AS n FROM postings WHERE NOT (contains(lower(company_name), '000') AND contains(lower(company_name), '#00000012')) GROUP BY company_name",
    "postings",
)
def f10_excluded_company(t: Tables) -> DataFrame:
    return t.postings.filter(filters.not_excluded_company(F.col("company_name"), ["#00000012"])).groupBy("company_name").agg(F.count("*").alias("n"))


STATUSES = "'SAVED', 'PREPARING', 'READY_TO_APPLY', 'APPLIED', 'INTERVIEW', 'OFFER', 'REJECTED', 'IGNORED'"


@query(f"SELECT job_id, title FROM postings WHERE job_id NOT IN (SELECT job_id FROM saved_jobs WHERE user_id = 1 AND status IN ({STATUSES}))", "postings", "saved_jobs")
def f11_anti_join(t: Tables) -> DataFrame:
    gone = t.saved_jobs.filter((F.col("user_id") == 1) & F.col("status").isin(filters.SEARCH_EXCLUDES))
    return filters.without(t.postings, gone, "job_id").select("job_id", "title")


@query("SELECT count(*) AS n, min(job_id) AS least FROM postings p WHERE NOT EXISTS (SELECT 1 FROM saved_jobs s WHERE s.job_id = p.job_id AND s.status = 'VIEWED')", "postings", "saved_jobs")
def f12_notified_anti(t: Tables) -> DataFrame:
    return filters.without(t.postings, t.saved_jobs.filter("status = 'VIEWED'"), "job_id").agg(F.count("*").alias("n"), F.min("job_id").alias("least"))


@query("SELECT job_id, max(overall_score) AS overall_score FROM matches GROUP BY job_id HAVING max(overall_score) >= 40", "matches")
def f13_score_threshold(t: Tables) -> DataFrame:
    return t.matches.groupBy("job_id").agg(F.max("overall_score").alias("overall_score")).filter("overall_score >= 40")


@query(
    """SELECT job_id, CASE WHEN length(trim(coalesce(title, ''))) < 3 THEN 'title_too_short_or_empty'
      WHEN length(trim(coalesce(company_name, ''))) < 2 THEN 'company_name_too_short_or_empty'
      WHEN NOT regexp_matches(coalesce(source_url, ''), '^https?://') THEN 'invalid_source_url'
      WHEN NOT regexp_matches(coalesce(application_url, ''), '^https?://') THEN 'invalid_application_url'
      WHEN length(trim(coalesce(description, ''))) < 10 THEN 'description_too_short_or_empty'
      WHEN job_id % 37 = 0 THEN 'invalid_or_missing_job_hash' END AS reason FROM postings""",
    "postings",
)
def f14_validation(t: Tables) -> DataFrame:
    rows = t.postings.withColumn("job_hash", F.when(F.col("job_id") % 37 != 0, F.sha2(F.col("job_id").cast("string"), 256)))
    return rows.select("job_id", filters.reject_reason().alias("reason"))


@query(
    f"""WITH a AS (SELECT *, greatest(0.0, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at)) / 1000000.0::DOUBLE / 3600, 2)) AS age FROM postings)
    SELECT job_id, CASE WHEN posted_at IS NULL THEN NULL ELSE age END AS age, posted_at IS NOT NULL AND coalesce(posted_at_confidence, '') IN ('HIGH', 'MEDIUM') AND age <= {HOURS} AS is_fresh,
      CASE WHEN posted_at IS NULL OR posted_at_confidence = 'LOW' THEN 'UNCERTAIN' WHEN coalesce(posted_at_confidence, '') IN ('HIGH', 'MEDIUM') AND age <= {HOURS} THEN 'FRESH' ELSE 'STALE' END AS class FROM a""",
    "postings",
)
def f15_freshness_class(t: Tables) -> DataFrame:
    # greatest() of a null age and 0 is 0: an undated posting has no age, and the struct's reason says why.
    got = times.freshness(F.col("posted_at"), F.col("posted_at_confidence"), HOURS, clock(NOW))
    age = F.when(F.col("posted_at").isNotNull(), got["age"])
    return t.postings.select("job_id", age.alias("age"), got["is_fresh"].alias("is_fresh"), times.freshness_class(F.col("posted_at"), F.col("posted_at_confidence"), HOURS, clock(NOW)).alias("class"))


@query(
    """SELECT count(*) FILTER (coalesce(experience_min, 0) = 0 OR employment_type = 'INTERNSHIP') AS fresher, count(*) FILTER (coalesce(experience_min, 0) <= 1) AS y0_1,
      count(*) FILTER (coalesce(experience_min, 0) >= 3 AND coalesce(experience_max, 99) >= 3) AS y3_plus FROM postings""",
    "postings",
)
def f16_client_tiers(t: Tables) -> DataFrame:
    return t.postings.agg(*[F.count_if(filters.experience_tier(k)).alias(n) for k, n in (("FRESHER", "fresher"), ("0_1", "y0_1"), ("3_PLUS", "y3_plus"))])


SKILL_LISTS = "SELECT job_id, list(skill ORDER BY skill) AS skills FROM posting_skills GROUP BY job_id"


def skill_lists(t: Tables) -> DataFrame:
    return t.posting_skills.groupBy("job_id").agg(F.array_sort(F.collect_list("skill")).alias("skills"))


@query(f"WITH s AS ({SKILL_LISTS}) SELECT job_id, len(skills) AS n FROM s WHERE len(list_filter(skills, lambda x: contains(lower(x), 'prom'))) > 0 AND len(list_filter(skills, lambda x: contains(lower(x), 'econ'))) > 0", "posting_skills")
def f17_all_skills(t: Tables) -> DataFrame:
    return skill_lists(t).filter(filters.all_skills(F.col("skills"), ["Prom", "econ"])).select("job_id", F.size("skills").cast("long").alias("n"))


@query("SELECT DISTINCT c_name AS company_name FROM customer WHERE contains(lower(c_name), '#0000001') ORDER BY 1 LIMIT 25")
def f19_suggest(t: Tables) -> DataFrame:
    return t.customer.filter(filters.suggest(F.col("c_name"), "#0000001")).select(F.col("c_name").alias("company_name")).distinct().orderBy("company_name").limit(25)


@query(f"SELECT event_id, CASE WHEN ts + INTERVAL 10 DAY < TIMESTAMP '{EVENTS_NOW}' THEN 'EXPIRED' WHEN event_type = 'error' THEN 'REJECTED' ELSE 'PENDING' END AS status FROM events")
def f20_approval_expiry(t: Tables) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "REJECTED")
    return t.events.select("event_id", profile.approval_step(F.lit("PENDING"), said, F.col("ts") + F.expr("INTERVAL 10 DAYS"), clock(EVENTS_NOW)).alias("status"))


@query("SELECT hours, arg_min(w, (abs(hours - w), w)) AS clamped FROM (SELECT DISTINCT user_id % 40 AS hours FROM events) h, (VALUES (1), (4), (8), (12), (16), (24)) v(w) GROUP BY hours")
def f21_clamp(t: Tables) -> DataFrame:
    return t.events.select((F.col("user_id") % 40).alias("hours")).distinct().withColumn("clamped", times.clamp_window(F.col("hours")))


@query("SELECT s.user_id, s.job_id, s.status, p.title, p.company_name FROM saved_jobs s JOIN postings p ON s.job_id = p.job_id WHERE s.status = 'SAVED'", "postings", "saved_jobs")
def j1_pipeline_join(t: Tables) -> DataFrame:
    return t.saved_jobs.filter("status = 'SAVED'").join(t.postings, "job_id").select("user_id", "job_id", "status", "title", "company_name")


@query(
    "SELECT s.event_id, s.job_id, m.match_id, m.overall_score FROM saved_jobs s LEFT JOIN matches m ON m.job_id = s.job_id AND m.profile_id = 0 WHERE s.user_id = 0",
    "saved_jobs",
    "matches",
)
def j2_left_match(t: Tables) -> DataFrame:
    own = t.matches.filter("profile_id = 0").select("job_id", "match_id", "overall_score")
    return t.saved_jobs.filter("user_id = 0").join(own, "job_id", "left").select("event_id", "job_id", "match_id", "overall_score")


@query("SELECT p.job_id, s.status FROM postings p LEFT JOIN (SELECT job_id, arg_max(status, event_id) AS status FROM saved_jobs WHERE user_id = 2 GROUP BY job_id) s ON p.job_id = s.job_id", "postings", "saved_jobs")
def j3_status_lookup(t: Tables) -> DataFrame:
    status = t.saved_jobs.filter("user_id = 2").groupBy("job_id").agg(F.max_by("status", "event_id").alias("status"))
    return t.postings.join(status, "job_id", "left").select("job_id", "status")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC, match_id) AS k FROM matches)
    SELECT job_id, match_id, overall_score FROM r WHERE k = 1""",
    "matches",
)
def j12_best_match(t: Tables) -> DataFrame:
    return keyed.best_per(t.matches, ["job_id"], F.desc("overall_score"), F.asc("match_id")).select("job_id", "match_id", "overall_score")


@query("SELECT e.event_id AS position, p.job_id, p.title FROM (SELECT event_id, event_id * 7 AS job_id FROM events WHERE event_type = 'view') e JOIN postings p ON p.job_id = e.job_id ORDER BY 1", "postings")
def j14_ordered_batch(t: Tables) -> DataFrame:
    ids = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("position"), (F.col("event_id") * 7).alias("job_id"))
    return keyed.in_order(t.postings, ids, "job_id").select("position", "job_id", "title")


@query(
    """WITH old AS (SELECT job_id, source_job_id, source_url FROM postings WHERE job_id % 2 = 0),
    a AS (SELECT source_job_id, min(job_id) AS x FROM old WHERE source_job_id IS NOT NULL GROUP BY 1), b AS (SELECT source_url, min(job_id) AS y FROM old GROUP BY 1)
    SELECT n.job_id, coalesce(x, y) AS found FROM postings n LEFT JOIN a USING (source_job_id) LEFT JOIN b USING (source_url) WHERE n.job_id % 2 = 1""",
    "postings",
)
def j10_two_key_match(t: Tables) -> DataFrame:
    rows = t.postings.select("job_id", "source_job_id", "source_url")
    found = keyed.two_key_match(rows.filter("job_id % 2 = 1"), rows.filter("job_id % 2 = 0").withColumnRenamed("job_id", "old_id"), "source_job_id", "source_url", "old_id")
    return found.select("job_id", "found")


@query("SELECT DISTINCT c_name AS company_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')")
def j11_missing_companies(t: Tables) -> DataFrame:
    return filters.without(t.customer.select("c_custkey", F.col("c_name").alias("company_name")), t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("company_name").distinct()


FACETS = f"""f AS (SELECT *, remote_type <> 'ONSITE' AS loc_ok, employment_type = 'FULL_TIME' AS type_ok,
  coalesce(experience_min <= 2 OR (experience_min IS NULL AND experience_max <= 2) OR (experience_min IS NULL AND experience_max IS NULL) OR employment_type = 'INTERNSHIP', false) AS exp_ok,
  employment_type = 'INTERNSHIP' OR contains(lower(title), 'intern') OR coalesce(contains(lower(experience_raw), 'intern'), false) AS intern,
  coalesce(experience_min, 0) AS lo, coalesce(experience_max, experience_min, 0) AS hi, coalesce(experience_raw, '') AS tx FROM postings WHERE {FRESH})"""


def faceted(t: Tables) -> DataFrame:
    rows = t.postings.filter(filters.fresh(clock(NOW), HOURS))
    return facets.flags(rows, F.col("remote_type") != "ONSITE", F.col("employment_type") == "FULL_TIME", filters.experience_at_most(2))


@query(f"WITH {FACETS} SELECT count(*) FILTER (loc_ok AND type_ok AND exp_ok) AS n_all, count(*) FILTER (loc_ok AND exp_ok AND NOT intern) AS n_jobs, count(*) FILTER (loc_ok AND exp_ok AND intern) AS n_internships FROM f", "postings")
def a1_facets_types(t: Tables) -> DataFrame:
    return facets.type_counts(faceted(t))


@query(f"WITH {FACETS} SELECT lower(source) AS source, count(*) AS n FROM f WHERE loc_ok AND type_ok AND exp_ok GROUP BY 1", "postings")
def a1_facets_sources(t: Tables) -> DataFrame:
    return facets.source_counts(faceted(t))


@query(
    f"""WITH {FACETS} SELECT count(*) FILTER (coalesce(experience_min = 0, false) OR intern OR contains(lower(tx), 'fresher') OR (experience_min IS NULL AND (experience_max IS NULL OR experience_max <= 1))) AS fresher,
      count(*) FILTER (coalesce(experience_min <= 1, false) OR coalesce(experience_max <= 1, false) OR intern) AS y0_1,
      count(*) FILTER ((lo <= 2 AND hi >= 1) OR contains(tx, '1-2') OR contains(tx, '0-2')) AS y1_2,
      count(*) FILTER ((lo <= 3 AND hi >= 2) OR contains(tx, '2-3') OR contains(tx, '1-3')) AS y2_3,
      count(*) FILTER (hi >= 3 OR lo >= 3) AS y3_plus FROM f WHERE loc_ok AND type_ok""",
    "postings",
)
def a1_facets_tiers(t: Tables) -> DataFrame:
    return facets.tier_counts(faceted(t))


@query(
    r"""SELECT place, count(*) AS n FROM (SELECT DISTINCT job_id, trim(x) AS place FROM (SELECT job_id, unnest(regexp_split_to_array(location, ' or |/|,')) AS x FROM postings)) WHERE place <> 'Unknown' GROUP BY place""",
    "postings",
)
def a1_facets_locations(t: Tables) -> DataFrame:
    return facets.location_counts(t.postings, F.transform(F.split("location", " or |/|,"), lambda x: F.trim(x)))


@query("SELECT status, count(*) AS n FROM saved_jobs GROUP BY status", "saved_jobs")
def a3_status_counts(t: Tables) -> DataFrame:
    return t.saved_jobs.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "SELECT count(*) FILTER (status = 'SAVED') AS saved, count(*) FILTER (status = 'APPLIED') AS applied, count(*) FILTER (status = 'OFFER') AS offer, count(*) FILTER (status = 'INTERVIEW') AS interview FROM saved_jobs",
    "saved_jobs",
)
def a4_pipeline_counts(t: Tables) -> DataFrame:
    return facets.status_counts(t.saved_jobs, ["SAVED", "APPLIED", "OFFER", "INTERVIEW"])


@query(f"SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 240 HOUR")
def a5_since_cutoff(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") >= clock(EVENTS_NOW) - F.expr("INTERVAL 240 HOURS")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (overall_score >= 70) AS at_least_70, count(*) FILTER (overall_score >= 80) AS at_least_80, count(*) FILTER (overall_score >= 85) AS at_least_85 FROM matches", "matches")
def a6_funnel(t: Tables) -> DataFrame:
    return t.matches.agg(*facets.funnel(F.col("overall_score"), 70, 80, 85))


@query(
    "SELECT skill, count(*) AS n, round(count(*) * 100.0 / (SELECT count(DISTINCT job_id) FROM posting_skills)::DOUBLE, 1) AS percent FROM posting_skills WHERE skill NOT IN ('PROMO', 'SMALL') GROUP BY skill ORDER BY n DESC, skill LIMIT 6",
    "posting_skills",
)
def a7_skill_gap(t: Tables) -> DataFrame:
    return facets.skill_gap(skill_lists(t), ["PROMO", "SMALL"])


@query("SELECT count(DISTINCT company_name) AS companies FROM postings", "postings")
def a8_distinct_companies(t: Tables) -> DataFrame:
    return t.postings.agg(F.countDistinct("company_name").alias("companies"))


@query(
    """WITH r AS (SELECT user_id % 20 AS source, event_type <> 'error' AS ok, event_id % 10 AS fetched FROM events)
    SELECT source, count(*) AS attempts, sum(fetched)::BIGINT AS fetched, CASE WHEN bool_and(ok) THEN 'success' WHEN bool_or(ok) THEN 'partial_success' ELSE 'failed' END AS status FROM r GROUP BY source"""
)
def a9_rollup(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 20).alias("source"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 10).alias("fetched"))
    return facets.rollup(rows)


@query("SELECT source, round(avg((salary_raw IS NOT NULL)::INT), 6) AS salary_yield, round(avg((experience_raw IS NOT NULL)::INT), 6) AS experience_yield FROM postings GROUP BY source", "postings")
def a10_yields(t: Tables) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6)
    return t.postings.groupBy("source").agg(share("salary_raw").alias("salary_yield"), share("experience_raw").alias("experience_yield"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM r WHERE k <= 100 GROUP BY event_type"""
)
def a11_last100(t: Tables) -> DataFrame:
    return facets.last_observations(t.events, "event_type", ["ts", "event_id"], "value")


@query(
    """WITH s AS (SELECT job_id, list(DISTINCT lower(skill)) AS p, list(DISTINCT lower(skill)) FILTER (skill IN ('PROMO', 'SMALL', 'LARGE')) AS x FROM posting_skills GROUP BY job_id),
    m AS (SELECT job_id, len(p) AS n, coalesce(len(x), 0) AS c FROM s)
    SELECT job_id, round(c / n::DOUBLE, 4) AS precision, round(c / 3.0::DOUBLE, 4) AS recall, CASE WHEN c = 0 THEN 0.0 ELSE round(2 * (c / n::DOUBLE) * (c / 3.0::DOUBLE) / (c / n::DOUBLE + c / 3.0::DOUBLE), 4) END AS f1 FROM m""",
    "posting_skills",
)
def a12_precision_recall(t: Tables) -> DataFrame:
    got = facets.precision_recall(F.col("skills"), F.array(F.lit("Promo"), F.lit("small"), F.lit("LARGE!")))
    return skill_lists(t).select("job_id", got["precision"].alias("precision"), got["recall"].alias("recall"), got["f1"].alias("f1"))


@query("SELECT employment_type, count(*) AS n, count(*) FILTER (posted_at IS NULL) AS undated FROM postings GROUP BY employment_type", "postings")
def a15_type_tallies(t: Tables) -> DataFrame:
    return t.postings.groupBy("employment_type").agg(F.count("*").alias("n"), F.count_if(F.col("posted_at").isNull()).alias("undated"))


@query(
    """WITH m AS (SELECT job_id, max(overall_score) AS overall_score FROM matches GROUP BY job_id)
    SELECT p.job_id, overall_score, quality_score, posted_at FROM postings p JOIN m ON p.job_id = m.job_id ORDER BY overall_score DESC NULLS LAST, quality_score DESC NULLS LAST, posted_at DESC NULLS LAST, p.job_id LIMIT 50""",
    "postings",
    "matches",
)
def o2_rank(t: Tables) -> DataFrame:
    best = t.matches.groupBy("job_id").agg(F.max("overall_score").alias("overall_score"))
    return t.postings.join(best, "job_id").select("job_id", "overall_score", "quality_score", "posted_at").orderBy(*keyed.rank_order()).limit(50)


@query("SELECT job_id, posted_at FROM postings ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 40", "postings")
def o3_newest(t: Tables) -> DataFrame:
    return t.postings.select("job_id", "posted_at").orderBy(F.desc_nulls_last("posted_at"), "job_id").limit(40)


@query("SELECT job_id, salary_max FROM postings ORDER BY coalesce(salary_max, 0) DESC, coalesce(salary_min, 0) DESC, job_id LIMIT 40", "postings")
def o4_salary_sort(t: Tables) -> DataFrame:
    return t.postings.orderBy(F.desc(F.coalesce("salary_max", F.lit(0.0))), F.desc(F.coalesce("salary_min", F.lit(0.0))), "job_id").select("job_id", "salary_max").limit(40)


@query(f"SELECT job_id FROM postings WHERE {FRESH} ORDER BY job_id LIMIT 20 OFFSET 40", "postings")
def o5_page(t: Tables) -> DataFrame:
    return keyed.page(t.postings.filter(filters.fresh(clock(NOW), HOURS)).select("job_id"), 3, 20, F.asc("job_id"))


@query(f"SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0::DOUBLE))::BIGINT AS pages FROM postings WHERE {FRESH}", "postings")
def o5_page_info(t: Tables) -> DataFrame:
    return keyed.page_info(t.postings.filter(filters.fresh(clock(NOW), HOURS)), 20)


@query(
    "SELECT job_id, dense_rank() OVER (ORDER BY quality_score DESC, job_id) AS place FROM postings SEMI JOIN (SELECT DISTINCT job_id FROM saved_jobs WHERE status = 'APPLIED') USING (job_id) QUALIFY place <= 30",
    "postings",
    "saved_jobs",
)
def o8_rank_ids(t: Tables) -> DataFrame:
    ids = t.saved_jobs.filter("status = 'APPLIED'").select("job_id")
    top = t.postings.join(ids, "job_id", "left_semi").select("job_id", "quality_score").orderBy(F.desc("quality_score"), "job_id").limit(30)
    # Thirty rows at most are numbered together.
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("quality_score"), "job_id")).cast("long")).select("job_id", "place")


@query(
    """WITH p AS (SELECT DISTINCT unnest(CASE location WHEN 'Bangalore, Karnataka' THEN ['Bengaluru'] WHEN 'BLR' THEN ['Bengaluru'] WHEN 'Pune / Mumbai' THEN ['Pune', 'Mumbai'] WHEN 'Gurgaon or Noida' THEN ['Gurugram', 'Noida']
      WHEN 'Chennai, Pune, Kochi' THEN ['Chennai', 'Pune', 'Kochi'] WHEN 'Pan India' THEN ['India'] WHEN 'Work from home' THEN ['Remote'] ELSE [location] END) AS place FROM postings)
    SELECT place, place NOT IN ('India', 'Remote', 'Springfield', 'Tamil Nadu') AS hub FROM p WHERE contains(lower(place), 'u')""",
    "postings",
)
def o12_places(t: Tables) -> DataFrame:
    return places.picker(t.postings, F.col("location"), " U")


@query(
    """SELECT job_id, CASE WHEN employment_type = 'INTERNSHIP' THEN 'Internship' WHEN coalesce(experience_raw, '') <> '' THEN experience_raw
      WHEN experience_min IS NOT NULL AND experience_max IS NOT NULL THEN experience_min || '-' || experience_max || ' years' WHEN experience_min IS NOT NULL THEN experience_min || '+ years' ELSE 'Not specified' END AS shown FROM postings""",
    "postings",
)
def t27_display(t: Tables) -> DataFrame:
    return t.postings.select("job_id", amounts.experience_display(F.col("employment_type"), F.col("experience_raw"), F.col("experience_min"), F.col("experience_max")).alias("shown"))
