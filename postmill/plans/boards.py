"""Queries of sources, sinks and candidate profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, places, profile, skills, times, titles
from ..operators import facets, keyed
from ..operators.tables import shared_folder
from ..sources import boards, sinks
from .registry import query
from .standins import EVENTS_NOW, NOW, Tables, clock


@query("SELECT job_id FROM postings WHERE contains(lower(concat_ws(' ', title, description, company_name, location)), 'docker') AND contains(lower(title), 'engineer') AND (contains(lower(location), 'pune') OR remote_type = 'REMOTE')", "postings")
def s1_pushed_search(t: Tables) -> DataFrame:
    return boards.search(t.postings, "Docker", ["Engineer"], ["Pune"]).select("job_id")


@query("SELECT job_id FROM postings WHERE application_url = 'https://acme.example/careers/10'", "postings")
def s2_by_url(t: Tables) -> DataFrame:
    return boards.by_url(t.postings, "https://acme.example/careers/10").select("job_id")


@query("SELECT job_id FROM postings WHERE contains(lower(title), 'backend') OR contains(lower(title), 'data engineer') OR contains(lower(title), 'react')", "postings")
def s18_planned_search(t: Tables) -> DataFrame:
    terms = boards.search_terms(" Backend ", ["Data Engineer"], ["react"], 8)
    return boards.search(t.postings, roles=terms).select("job_id")


def listing(t: Tables) -> DataFrame:
    """Listing pages, one per user: a card per event."""
    card = F.concat(
        F.lit('<li><div class="base-search-card" data-entity-urn="urn:li:jobPosting:'), (F.lit(1000000) + F.col("event_id")).cast("string"), F.lit('"><a class="base-card__full-link" href="https://x.example/v/'), F.col("event_id").cast("string"),
        F.lit('?ref=1"></a><h3 class="base-search-card__title"> '), "event_type", F.lit(" <b>role</b></h3>"), F.when(F.col("event_id") % 5 == 0, F.lit("<h4>Confidential</h4>")).otherwise(F.concat(F.lit("<h4>other</h4>"), F.lit('<h4 class="base-search-card__subtitle">Co&amp;'), F.col("user_id").cast("string"), F.lit("</h4>"))),
        F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.lit('<span class="job-search-card__location">Pune<br></span>')), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit('<time datetime="2024-01-02">new</time>')), F.lit("</div></li>"),
    )
    page = F.concat(F.lit('<html><div class="base-card"><h3>no company</h3></div><ul>'), F.array_join(F.sort_array(F.collect_list(card)), ""), F.lit("<h3>outside</h3></ul></html>"))
    return t.events.groupBy("user_id").agg(page.alias("html"))


@query("SELECT user_id, (1000000 + event_id)::VARCHAR AS id, event_type || ' role' AS title, CASE WHEN event_id % 5 <> 0 THEN 'Co&' || user_id END AS company, CASE WHEN event_id % 4 <> 0 THEN 'Pune' END AS location, CASE WHEN event_id % 3 <> 0 THEN '2024-01-02' END AS time, 'https://x.example/v/' || event_id AS url FROM events")
def s3_cards(t: Tables) -> DataFrame:
    return boards.cards(listing(t), "user_id", "html", *boards.BOARDS["board1"])


@query("SELECT count(*) AS cards, 1.0::DOUBLE AS title_yield, round(avg((event_id % 5 <> 0)::INT), 4) AS company_yield, round(avg((event_id % 4 <> 0)::INT), 4) AS location_yield, round(avg((event_id % 3 <> 0)::INT), 4) AS time_yield, avg((event_id % 5 <> 0)::INT) < 0.85 AS degraded FROM events")
def s8_yields(t: Tables) -> DataFrame:
    return boards.yields(boards.cards(listing(t), "user_id", "html", *boards.BOARDS["board1"]))


@query("SELECT event_id, event_id::VARCHAR AS source_job_id, CASE WHEN event_id % 2 = 0 THEN 'Pune' ELSE 'India' END AS location, CASE WHEN event_id % 3 = 0 THEN 'REMOTE' ELSE 'ONSITE' END AS remote_type, '2023-11-14 22:13:20' AS posted_time_raw, 'https://b.example/job-listings-' || event_id AS source_url, 2 AS n_skills FROM events")
def s5_payload(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit('{"jobDetails": [{"jobId": "'), F.col("event_id").cast("string"), F.lit('", "title": "Dev", "companyName": "C", "createdDate": 1700000000000, "tagsAndSkills": "python, sql", "workMode": "'),
        F.when(F.col("event_id") % 3 == 0, "Remote").otherwise("Office"), F.lit('", "placeholders": ['), F.when(F.col("event_id") % 2 == 0, '{"type": "location", "label": "Pune"}').otherwise('{"type": "salary", "label": "5 LPA"}'), F.lit("]}]}"),
    )
    rows = t.events.select("event_id", F.explode(boards.from_payload(body, "https://b.example")).alias("j"))
    return rows.select("event_id", "j.source_job_id", "j.location", "j.remote_type", "j.posted_time_raw", "j.source_url", F.size("j.skills").alias("n_skills"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'bad_header' WHEN 2 THEN 'unsupported' END AS problem FROM customer")
def s16_uploads(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 2, ".exe").otherwise(".PDF"))
    content = F.when(k == 0, F.lit("")).when(k == 3, F.concat(F.lit("%PDF-1.7 "), "c_name")).otherwise(F.col("c_name")).cast("binary")
    return t.customer.select("c_custkey", boards.upload_problem(name, content).alias("problem"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'rate_limit_block' WHEN event_type = 'error' THEN 'transient_network' WHEN event_type = 'view' THEN 'parse_extraction' WHEN event_type = 'signup' THEN 'source_config' ELSE 'fatal' END AS category, event_id % 7 <> 0 AND event_type = 'error' AS retryable FROM events")
def s24_error_class(t: Tables) -> DataFrame:
    said = F.when(F.col("event_type") == "signup", "Source config: no field map").when(F.col("event_type") == "error", "Connection reset by peer").when(F.col("event_type") == "view", "could not PARSE card").otherwise("boom")
    got = boards.classify_error(said, F.when(F.col("event_id") % 7 == 0, 429))
    return t.events.select("event_id", got["category"].alias("category"), got["retryable"].alias("retryable"))


@query(
    "SELECT job_id, least(100.0, 40.0 + 20 + CASE WHEN salary_raw IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN coalesce(contains(application_url, 'careers'), false) THEN 15 ELSE 0 END + CASE posted_at_confidence WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 0 END)::DOUBLE AS quality FROM postings",
    "postings",
)
def t25_quality(t: Tables) -> DataFrame:
    return t.postings.select("job_id", boards.quality(F.col("company_name"), F.col("salary_raw"), F.col("application_url"), F.col("posted_at_confidence"), F.lit(0)).alias("quality"))


@query("SELECT user_id::VARCHAR AS source, 'success' AS status, NULL AS error_category, count(*) AS total_discovered, 0 AS fresh_jobs FROM events GROUP BY user_id")
def k3_audit(t: Tables) -> DataFrame:
    stats = t.events.groupBy(F.col("user_id").cast("string").alias("source")).agg(F.count("*").alias("total_discovered"))
    return sinks.audit_rows(stats, F.lit(NOW)).select("source", "status", "error_category", "total_discovered", "fresh_jobs")


@query("SELECT '# TYPE events_' || event_type || ' gauge' || chr(10) || 'events_' || event_type || ' ' || printf('%.4f', sum(value)) AS line FROM events GROUP BY event_type")
def k9_exposition(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.concat(F.lit("Events."), "event_type").alias("name")).agg(F.sum("value").alias("value"))
    return sinks.exposition(rows.withColumn("kind", F.lit("gauge")))


_LAST = """h AS (SELECT 'value{event_type="' || event_type || '"}' AS key, count(*) AS n, round(avg(value), 4) AS a, round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(sum(value), 4) AS s
    FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY event_type)"""


def last_values(t: Tables) -> DataFrame:
    return sinks.histograms(t.events, F.concat(F.lit('value{event_type="'), "event_type", F.lit('"}')), ["ts", "event_id"], "value")


@query(f"WITH {_LAST} SELECT key, n AS count, a AS avg_sec, lo AS min_sec, hi AS max_sec FROM h")
def k9_histograms(t: Tables) -> DataFrame:
    """The summaries as they come back from JSON."""
    told = sinks.histogram_json(last_values(t))
    return told.select("key", F.from_json("json", "count long, avg_sec double, min_sec double, max_sec double").alias("j")).select("key", "j.*")


@query(f"WITH {_LAST} SELECT 'value_count' || key[6:] || ' ' || n AS line FROM h UNION ALL SELECT 'value_sum' || key[6:] || ' ' || printf('%.4f', s) FROM h")
def k9_histogram_lines(t: Tables) -> DataFrame:
    return sinks.histogram_lines(last_values(t))


@query(
    """SELECT d.doc_id, coalesce(lang, CASE WHEN l.doc_id IS NOT NULL THEN 'xx' END) AS lang, coalesce(source, 'quality' || quality) AS source,
      CASE WHEN l.doc_id IS NOT NULL THEN '{"lang":"xx","source":"quality' || quality || '"}' END AS payload FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id"""
)
def k12_fill_if_null(t: Tables) -> DataFrame:
    found = t.labels.groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.lit("xx").alias("lang"), F.concat(F.lit("quality"), F.col("q").cast("string")).alias("source"))
    return keyed.fill_null(t.documents.select("doc_id", "lang", "source"), found, "doc_id", ["lang", "source"])


@query(
    f"SELECT event_id, CASE WHEN event_type = 'signup' THEN 'APPROVED' WHEN ts + INTERVAL 15 DAY < TIMESTAMP '{EVENTS_NOW}' THEN 'EXPIRED' WHEN event_type = 'purchase' THEN 'APPROVED' WHEN event_type = 'error' THEN 'REJECTED' ELSE 'PENDING' END AS status FROM events"
)
def r12_approvals(t: Tables) -> DataFrame:
    was = F.when(F.col("event_type") == "signup", "APPROVED").otherwise("PENDING")
    said = F.when(F.col("event_type") == "purchase", "APPROVED").when(F.col("event_type") == "error", "REJECTED")
    return t.events.select("event_id", profile.approval_step(was, said, F.col("ts") + F.expr("INTERVAL 15 DAYS"), clock(EVENTS_NOW)).alias("status"))


@query(
    """SELECT job_id, CASE WHEN employment_type <> 'INTERNSHIP' AND (coalesce(experience_min > 2, false) OR title IN ('Principal Architect', 'Sr. Data Engineer', 'Engg Manager')) THEN 1 ELSE 0 END + CASE WHEN coalesce(salary_max = 0, false) THEN 1 ELSE 0 END + CASE WHEN location = 'Springfield' THEN 1 ELSE 0 END AS n FROM postings""",
    "postings",
)
def c9_exclusions(t: Tables) -> DataFrame:
    reasons = profile.exclusion_reasons(2, F.col("salary_max") == 0, F.col("location") == "Springfield", F.lit(False), F.lit(False))
    return t.postings.select("job_id", F.size(reasons).alias("n"))


@query(
    """WITH s AS (SELECT job_id, list(skill ORDER BY skill) AS k FROM posting_skills GROUP BY job_id), m AS (SELECT job_id, list_filter(k, lambda x: x NOT IN ('PROMO', 'SMALL')) AS missing FROM s)
    SELECT job_id, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) > 0 THEN 'Days 1-4: ' || missing[1] END AS first FROM m""",
    "posting_skills",
)
def c16_skill_plan(t: Tables) -> DataFrame:
    from .feed import skill_lists

    got = profile.skill_plan(F.array(F.lit("PROMO"), F.lit("SMALL")), F.col("skills"))
    return skill_lists(t).select("job_id", F.array_join(got["missing"], ",").alias("missing"), F.get(got["plan"], 0).alias("first"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE coalesce(source, lang) END AS merged FROM documents")
def c17_merge(t: Tables) -> DataFrame:
    overrides = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("lang"))).otherwise(F.array().cast("array<string>"))
    return t.documents.select("doc_id", profile.merge_field(overrides, "lang", F.col("lang"), F.col("source")).alias("merged"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS contact FROM customer")
def t41_contact(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, " N/A ").otherwise(F.concat(F.lit(" "), "c_name"))
    return t.customer.select("c_custkey", profile.contact(F.lit(""), name, F.col("c_mktsegment")).alias("contact"))


@query(
    """WITH e AS (SELECT unnest(CASE location WHEN 'Bangalore, Karnataka' THEN ['Karnataka:Bengaluru'] WHEN 'BLR' THEN ['Karnataka:Bengaluru'] WHEN 'Pune / Mumbai' THEN ['Maharashtra:Pune', 'Maharashtra:Mumbai'] WHEN 'Gurgaon or Noida' THEN ['Haryana:Gurugram', 'Uttar Pradesh:Noida']
      WHEN 'Hyderabad' THEN ['Telangana:Hyderabad'] WHEN 'Chennai, Pune, Kochi' THEN ['Tamil Nadu:Chennai', 'Maharashtra:Pune', 'Kerala:Kochi'] WHEN 'Tamil Nadu' THEN ['Tamil Nadu:'] WHEN 'Delhi NCR' THEN ['Delhi:'] END) AS e FROM postings)
    SELECT split_part(e, ':', 1) AS state, coalesce(string_agg(DISTINCT nullif(split_part(e, ':', 2), ''), ',' ORDER BY nullif(split_part(e, ':', 2), '')), '') AS cities, count(*) AS n FROM e GROUP BY 1""",
    "postings",
)
def t16_taxonomy(t: Tables) -> DataFrame:
    return places.tree(t.postings, F.col("location")).withColumn("cities", F.array_join("cities", ","))


@query("SELECT location, CASE location WHEN 'Bangalore, Karnataka' THEN 'Bengaluru,India' WHEN 'BLR' THEN 'Bengaluru,India' WHEN 'Pune / Mumbai' THEN 'Pune,Mumbai,India' WHEN 'Gurgaon or Noida' THEN 'Gurugram,Noida,India' WHEN 'Chennai, Pune, Kochi' THEN 'Chennai,Pune,Kochi,India' WHEN 'Pan India' THEN 'India' WHEN 'Work from home' THEN 'Remote,India' ELSE location || ',India' END AS names FROM (SELECT DISTINCT location FROM postings)", "postings")
def t40_preferred_places(t: Tables) -> DataFrame:
    return t.postings.select("location").distinct().select("location", F.array_join(places.canonical_preferences(F.array(F.col("location"), F.lit("india"), F.col("location"))), ",").alias("names"))


@query("SELECT hour(ts) AS h, CASE WHEN hour(ts) < 12 THEN 'Good morning' WHEN hour(ts) < 17 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting, count(*) AS n FROM events GROUP BY ALL")
def t38_greeting(t: Tables) -> DataFrame:
    return t.events.groupBy(F.hour("ts").alias("h"), times.greeting(F.col("ts")).alias("greeting")).agg(F.count("*").alias("n"))


@query("SELECT event_id, greatest(0.0, round((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 1000000.0::DOUBLE / 3600, 2)) AS age FROM events")
def t18_age(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.age_hours(F.col("ts"), clock("2024-01-15 00:00:00")).alias("age"))


@query("SELECT user_id % 100 AS threshold, CASE WHEN user_id % 100 > 90 THEN 'match_threshold' WHEN user_id % 30 NOT IN (1, 4, 8, 12, 16, 24) THEN 'freshness_hours' END AS problem FROM (SELECT DISTINCT user_id FROM events)")
def f22_preferences(t: Tables) -> DataFrame:
    u = F.col("user_id")
    rows = t.events.select("user_id").distinct().select((u % 100).alias("threshold"), F.when(u % 100 > 90, 101).otherwise(u % 100).alias("match_threshold"), (u % 30).alias("freshness_hours"), F.lit(2).alias("experience_max_years"), F.lit("jobs").alias("role_type"))
    return rows.select("threshold", profile.preference_problem().alias("problem"))


@query("SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'purchase' AND value > 40), max(event_id) FILTER (event_type = 'signup'), max(event_id)) AS chosen FROM events GROUP BY user_id")
def j16_active_choice(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return keyed.first_choice(t.events, ["user_id"], "event_id", (kind == "purchase") & (F.col("value") > 40), kind == "signup")


@query("SELECT count(*) FILTER (ok) AS healthy, bool_and(ok) AS all_healthy, CASE WHEN bool_and(ok) THEN 'ok' ELSE 'degraded' END AS status FROM (SELECT user_id, arg_max(event_type, event_id) <> 'error' AS ok FROM events GROUP BY user_id)")
def a19_source_health(t: Tables) -> DataFrame:
    last = keyed.best_per(t.events, ["user_id"], F.desc("event_id")).select((F.col("event_type") != "error").alias("ok"))
    return last.agg(F.count_if("ok").alias("healthy"), F.bool_and("ok").alias("all_healthy"), F.when(F.bool_and("ok"), "ok").otherwise("degraded").alias("status"))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 30 OFFSET 20")
def o10_run_listing(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role").orderBy("conv_id", "turn").offset(20).limit(30)


_PAGE = """SELECT event_id, event_id % 4 AS kind, event_type || ' role' AS title, 'Co ' || user_id AS company FROM events"""


@query(f"SELECT event_id, CASE WHEN kind < 3 THEN title END AS title, CASE WHEN kind < 3 THEN company END AS company, CASE kind WHEN 0 THEN 'Pune, IN' WHEN 1 THEN 'India' WHEN 2 THEN 'Kochi' END AS location, CASE kind WHEN 0 THEN 'About' WHEN 1 THEN title || ' at ' || company || '.' WHEN 2 THEN 'Long text' END AS description, CASE kind WHEN 0 THEN 'JSON_LD' WHEN 1 THEN 'CARD' WHEN 2 THEN 'CSS_SELECTOR' ELSE 'NONE' END AS provenance FROM ({_PAGE})")
def s4_detail(t: Tables) -> DataFrame:
    title, company = F.concat("event_type", F.lit(" role")), F.concat(F.lit("Co "), F.col("user_id").cast("string"))
    linked = F.concat(F.lit('<script type="application/ld+json">{"@type": "JobPosting", "title": "'), title, F.lit('", "hiringOrganization": {"name": "'), company, F.lit('"}, "description": "<p>About</p>", "jobLocation": {"address": {"addressLocality": "Pune", "addressCountry": "IN"}}}</script>'))
    card = F.concat(F.lit('<div class="base-search-card"><h3>'), title, F.lit('</h3><h4 class="base-search-card__subtitle">'), company, F.lit("</h4></div>"))
    header = F.concat(F.lit("<h1>"), title, F.lit('</h1><a class="topcard__org-name-link">'), company, F.lit('</a><span class="topcard__flavor--bullet">Kochi</span><div class="description__text"><p>Long</p> text</div>'))
    kind = F.col("event_id") % 4
    pages = t.events.select("event_id", F.concat(F.lit("<html>"), F.when(kind == 0, linked).when(kind == 1, card).when(kind == 2, header).otherwise("<p>gone</p>"), F.lit("</html>")).alias("html"))
    return boards.detail(pages, "event_id", "html").select("event_id", *[F.col(f"record.{c}").alias(c) for c in ("title", "company", "location", "description")], "provenance")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'main ' || event_type END AS heading, value::VARCHAR AS price FROM events")
def s14_schema(t: Tables) -> DataFrame:
    heading = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.lit('<div class="b">side</div><b class="a">main '), "event_type", F.lit("</b>"))).otherwise(F.concat(F.lit('<i class="b">main '), "event_type", F.lit("</i>")))
    pages = t.events.select("event_id", F.concat(heading, F.lit('<span class="x price">'), F.col("value").cast("string"), F.lit("</span>")).alias("html"))
    return boards.extract(pages, "event_id", "html", {"heading": ["a", "b"], "price": ["price"]})


_HASH = "sha256(concat_ws('|', regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(location), '[^a-z0-9]', '', 'g'), regexp_replace(lower(employment_type), '[^a-z0-9]', '', 'g'), coalesce(regexp_replace(lower(source_job_id), '[^a-z0-9]', '', 'g'), 'generic')))"


@query(
    f"""WITH p AS (SELECT job_id, {_HASH} AS job_hash, source_url, title, salary_max, posted_at, posted_at_confidence, is_active FROM postings),
    o AS (SELECT * FROM p WHERE job_id % 3 <> 0), n AS (SELECT * FROM p WHERE job_id % 3 = 0),
    m AS (SELECT n.*, coalesce(x, y) AS found FROM n LEFT JOIN (SELECT job_hash, min(job_id) AS x FROM o GROUP BY 1) USING (job_hash) LEFT JOIN (SELECT source_url, min(job_id) AS y FROM o GROUP BY 1) USING (source_url)),
    g AS (SELECT found, arg_min(salary_max, job_id) FILTER (salary_max IS NOT NULL) AS s, arg_max(title, job_id) AS ti, max(posted_at) AS po, arg_max([posted_at_confidence], (posted_at, -job_id)) FILTER (posted_at IS NOT NULL) AS c FROM m WHERE found IS NOT NULL GROUP BY found),
    k AS (SELECT o.*, g.*, coalesce(po > posted_at, po IS NOT NULL AND posted_at IS NULL) AS later FROM o LEFT JOIN g ON job_id = found)
    SELECT job_id, coalesce(ti, title) AS title, coalesce(salary_max, s) AS salary_max, CASE WHEN later THEN po ELSE posted_at END AS posted_at, CASE WHEN later THEN c[1] ELSE posted_at_confidence END AS confidence, is_active OR found IS NOT NULL AS is_active, CASE WHEN found IS NULL THEN 'kept' ELSE 'updated' END AS action FROM k
    UNION ALL SELECT job_id, title, salary_max, posted_at, posted_at_confidence, is_active, 'inserted' FROM m WHERE found IS NULL QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY job_id) = 1""",
    "postings",
)
def k1_two_keys(t: Tables) -> DataFrame:
    job_hash = identity.fingerprint(*[F.col(c) for c in ("company_name", "title", "location", "employment_type", "source_job_id")])
    rows = t.postings.select("job_id", job_hash.alias("job_hash"), "source_url", "title", "salary_max", "posted_at", "posted_at_confidence", "is_active")
    got = keyed.upsert_two_keys(rows.filter("job_id % 3 <> 0"), rows.filter("job_id % 3 = 0"), "job_hash", "source_url", "job_id", ["salary_max"], ["title"], "posted_at", ["posted_at_confidence"])
    return got.select("job_id", "title", "salary_max", "posted_at", F.col("posted_at_confidence").alias("confidence"), "is_active", "action")


@query(
    """WITH k AS (SELECT lower(c_name) AS n, any_value(c_name) AS name, CASE WHEN any_value(c_custkey) % 2 = 0 THEN 'logo' || any_value(c_custkey) END AS logo FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1),
    f AS (SELECT lower(c_name) AS n, min(c_name) AS name, min(c_mktsegment) AS logo FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT coalesce(k.n, f.n) AS normalized_name, coalesce(k.name, f.name) AS name, coalesce(k.logo, f.logo) AS logo, k.name IS NULL AS created FROM k FULL JOIN f ON k.n = f.n"""
)
def k1_companies(t: Tables) -> DataFrame:
    logo = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("logo"), F.col("c_custkey").cast("string")))
    known = t.customer.filter("c_custkey % 3 <> 0").select(F.lower("c_name").alias("normalized_name"), F.col("c_name").alias("name"), logo.alias("logo"))
    seen = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "c_mktsegment")
    return keyed.get_or_create(known, seen, "c_name", "c_mktsegment")


@query("SELECT ts, event_type AS query, event_id AS results FROM events WHERE user_id = 7 ORDER BY ts DESC, results DESC, query DESC LIMIT 50")
def k5_search_history(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/postmill/history/{uuid.uuid4().hex}"
    rows = t.events.select("ts", "user_id", F.col("event_id").alias("results"), F.col("event_type").alias("query"))
    for part in (rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'")):
        part.write.mode("append").parquet(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return sinks.last_rows(t.spark, path, schema, F.col("user_id") == 7, "ts", keyed.bounded(500, 10, 50)).select("ts", "query", "results")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, doc_id = max(doc_id) OVER (PARTITION BY lang) AS is_active FROM documents")
def k13_resumes(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    return keyed.active_latest(rows, "lang", F.desc("doc_id")).select("doc_id", "hash", "is_active")


@query("SELECT event_id, s.job_id, p.title, p.company_name FROM saved_jobs s LEFT JOIN postings p ON s.job_id = p.job_id WHERE s.status = 'SAVED'", "saved_jobs", "postings")
def j13_approvals(t: Tables) -> DataFrame:
    jobs = t.postings.select("job_id", "title", "company_name")
    return t.saved_jobs.filter("status = 'SAVED'").select("event_id", "job_id").join(jobs, "job_id", "left").select("event_id", "job_id", "title", "company_name")


def extraction_cases(t: Tables) -> DataFrame:
    """An extracted and a true profile per order: kinds and brands of parts as skills."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    lists = rows.groupBy("l_orderkey").agg(F.collect_set("p_type").alias("p"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("p_type"))).alias("q"), F.max("l_linenumber").cast("int").alias("y"), F.min("l_linenumber").cast("int").alias("x"))
    side = lambda c, level, years: F.struct(F.col(c).alias("skills"), level.alias("experience_level"), F.col(years).alias("experience_years"))
    return lists.select("l_orderkey", side("p", F.lit("Mid"), "y").alias("predicted"), side("q", F.when(F.col("y") > 3, "MID").otherwise("senior"), "x").alias("truth"))


_CASES = """c AS (SELECT l_orderkey, count(DISTINCT p_type) AS p, count(DISTINCT p_type) FILTER (l_returnflag <> 'R') AS q, max(l_linenumber) AS y, min(l_linenumber) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
    m AS (SELECT *, CASE WHEN q = 0 THEN 0.0 ELSE q / p::DOUBLE END AS pr, 1.0::DOUBLE AS re, CASE WHEN q = 0 THEN 0.0 ELSE round(2 * (q / p::DOUBLE) / (q / p::DOUBLE + 1), 4) END AS f FROM c)"""


@query(f"WITH {_CASES} SELECT l_orderkey, round(pr, 4) AS precision, f AS f1, CASE WHEN y > 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS level_match, (y - x)::INT AS years_diff, p AS predicted, q AS truth FROM m")
def a13_profile_records(t: Tables) -> DataFrame:
    got = facets.profile_record(F.col("predicted"), F.col("truth"))
    rows = extraction_cases(t).select("l_orderkey", got.alias("r"))
    return rows.select("l_orderkey", F.col("r.skill_precision").alias("precision"), F.col("r.skill_f1").alias("f1"), F.col("r.experience_level_match").alias("level_match"), F.col("r.experience_years_diff").alias("years_diff"), F.col("r.predicted_count").alias("predicted"), F.col("r.truth_count").alias("truth"))


@query(f"WITH {_CASES} SELECT l_orderkey, f AS required_f1, round(pr, 4) AS required_precision, f AS stack_f1, CASE WHEN y > 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS seniority_match FROM m")
def a13_enrichment_records(t: Tables) -> DataFrame:
    side = lambda c: F.struct(F.col(f"{c}.skills").alias("required_skills"), F.col(f"{c}.skills").alias("preferred_skills"), F.col(f"{c}.skills").alias("tech_stack"), F.col(f"{c}.experience_level").alias("seniority"))
    rows = extraction_cases(t).select("l_orderkey", facets.enrichment_record(side("predicted"), side("truth")).alias("r"))
    return rows.select("l_orderkey", F.col("r.required_skills_f1").alias("required_f1"), F.col("r.required_skills_precision").alias("required_precision"), F.col("r.tech_stack_f1").alias("stack_f1"), "r.seniority_match")


@query(f"WITH {_CASES}, v AS (SELECT CASE WHEN y > 4 THEN 'resume' ELSE 'job' END AS k, f, q > 0 AS ok, y * 2.5::DOUBLE AS ms FROM m) SELECT count(*) AS total_fixtures, round(avg(ok::INT), 4) AS schema_valid_rate, round(avg(ms), 2) AS avg_latency_ms, round(coalesce(avg(f) FILTER (k = 'resume'), 0), 4) AS avg_resume_skill_f1, round(coalesce(avg(f) FILTER (k = 'job'), 0), 4) AS avg_job_required_skill_f1 FROM v")
def a14_report(t: Tables) -> DataFrame:
    got = facets.profile_record(F.col("predicted"), F.col("truth"))
    years = F.col("predicted.experience_years")
    return facets.evaluation_report(extraction_cases(t).select(F.when(years > 4, "resume").otherwise("job").alias("category"), (F.size("truth.skills") > 0).alias("schema_valid"), (years * 2.5).alias("latency_ms"), got["skill_f1"].alias("f1")))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AND (c_custkey % 3 = 0 OR n > 0) AS has_profile, n > 0 AS has_resume, c_custkey % 5 <> 0 AS has_sources, c_custkey % 2 = 0 AS has_ai_provider FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey, (SELECT 0) z(x), LATERAL (SELECT coalesce(k, 0) AS n)")
def a18_setup(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    key, none = F.col("c_custkey"), F.array().cast("array<string>")
    own = F.struct(F.when(key % 3 == 0, F.array(F.lit("x"))).otherwise(none).alias("target_roles"), none.alias("skills"), F.coalesce("n", F.lit(0)).alias("experience_years"))
    got = profile.setup_flags(F.when(key % 4 != 0, own), F.col("n"), key % 5 != 0, F.when(key % 2 == 0, "local"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", *[got[c].alias(c) for c in ("has_profile", "has_resume", "has_sources", "has_ai_provider")])


@query()
def c18_fallback(t: Tables) -> DataFrame:
    rows = skills.with_skills(t.postings, F.col("description"), F.col("title"), F.array().cast("array<string>"))
    got = profile.fallback_enrichment(titles.normalize_title(F.col("title")), titles.categorize_role(F.col("title")), F.col("experience_min"), F.col("required"), F.col("preferred"))
    own = profile.fallback_profile(F.col("required"))
    return rows.select("job_id", got.alias("e"), own.alias("p")).select("job_id", "e.standardized_title", "e.role_category", "e.seniority", F.array_join("e.tech_stack", ",").alias("tech_stack"), F.get("e.requirements_summary", 0).alias("summary"), F.array_join("p.skills", ",").alias("skills"))


@query(
    """SELECT job_id, CASE WHEN recency_raw IN ('2001-08-02', '2001-08-01', '2001-07-20', 'soon', '3 months ago', '2 days ago') OR recency_raw IS NULL THEN 'page' ELSE 'text' END AS taken FROM postings""",
    "postings",
)
def t19_chosen_recency(t: Tables) -> DataFrame:
    got = times.chosen_recency(F.col("recency_raw"), F.lit("2001-07-01T10:00:00Z"), clock(NOW))
    return t.postings.select("job_id", F.when(F.unix_seconds(got["ts"]) == 993981600, "page").otherwise("text").alias("taken"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1700000000 + event_id ELSE epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - 7200 END AS at, 'HIGH' AS confidence FROM events")
def t19_epoch_recency(t: Tables) -> DataFrame:
    millis = F.when(F.col("event_id") % 3 == 0, F.concat(((F.lit(1_700_000_000).cast("long") + F.col("event_id")) * 1000).cast("string"), F.lit(".0"))).otherwise("soon")
    got = times.epoch_recency(millis, F.lit("2 hours ago"), clock(EVENTS_NOW))
    return t.events.select("event_id", F.unix_seconds(got["ts"]).alias("at"), got["confidence"].alias("confidence"))


_SURE = "CASE WHEN posted_at_confidence = 'HIGH' THEN 10.0 ELSE 0.0 END"


@query(
    f"""SELECT job_id, (75.0 + CASE WHEN salary_raw IS NOT NULL THEN 15.0 ELSE 0.0 END + {_SURE})::DOUBLE AS by_salary,
      least(100.0, 75.0 + CASE WHEN salary_raw IS NOT NULL THEN 15.0 ELSE 0.0 END + {_SURE} + CASE WHEN length(description || description) >= 350 THEN 10.0 WHEN length(description || description) >= 200 THEN 5.0 ELSE 0.0 END
        + CASE WHEN coalesce(n, 0) >= 3 THEN 10.0 WHEN n >= 1 THEN 5.0 ELSE 0.0 END - CASE WHEN quality_score < 60 THEN 10.0 ELSE 0.0 END)::DOUBLE AS by_detail
    FROM postings p LEFT JOIN (SELECT job_id AS j, count(*) AS n FROM posting_skills GROUP BY 1) ON p.job_id = j""",
    "postings",
    "posting_skills",
)
def t25_board_quality(t: Tables) -> DataFrame:
    n = t.posting_skills.groupBy("job_id").agg(F.count("*").alias("n"))
    rows, sure = t.postings.join(n, "job_id", "left"), F.col("posted_at_confidence")
    salary = F.col("salary_raw").isNotNull()
    detail = boards.quality_by_detail(salary, F.concat("description", "description"), sure, F.coalesce("n", F.lit(0)), F.col("quality_score") / 100)
    return rows.select("job_id", boards.quality_by_salary(salary, sure).alias("by_salary"), detail.alias("by_detail"))


@query("SELECT job_id, CASE WHEN description = 'short' THEN title || ' at ' || company_name || '.' ELSE description || description END AS description, CASE WHEN description <> 'short' AND length(description || description) >= 200 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM postings", "postings")
def t26_described(t: Tables) -> DataFrame:
    got = boards.described(F.when(F.col("description") == "short", "  ").otherwise(F.concat(F.lit(" "), "description", "description")), F.col("title"), F.col("company_name"))
    return t.postings.select("job_id", got["description"].alias("description"), got["confidence"].alias("confidence"))


@query("SELECT doc_id, substr(nullif(text, ''), 1, CASE WHEN doc_id % 2 = 0 THEN 350 ELSE 300 END) AS company_summary, CASE WHEN doc_id % 3 = 0 THEN 'a,b,c,d' WHEN doc_id % 3 = 1 THEN nullif(lang, '') END AS products FROM documents")
def t34_research(t: Tables) -> DataFrame:
    """Every document as an answer of a model: a null or empty text is no summary, a null language no product."""
    rows = t.documents
    k = F.col("doc_id") % 3
    listed = F.when(k == 0, F.to_json(F.struct(F.array(*map(F.lit, "abcde")).alias("products")))).when(k == 1, F.to_json(F.struct(F.col("lang").alias("core_products")))).otherwise("{}")
    said = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("about")))).otherwise(F.to_json(F.struct("text")))
    raw = F.when(listed == "{}", said).otherwise(F.concat(F.substring(said, F.lit(1), F.length(said) - 1), F.lit(","), F.substring(listed, F.lit(2), F.length(listed))))
    got = profile.research_notes(raw)
    return rows.select("doc_id", got["company_summary"].alias("company_summary"), F.array_join(got["products"], ",").alias("products"))
