"""Queries of the text functions, dedup and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, findings, identity, markup, places, skills, times, titles, vectors
from ..operators import dedup, dictionary
from ..operators.tables import cut_lineage
from .registry import query
from .standins import NOW, Tables, clock

ALIAS_ROWS = ", ".join(f"('{a}', '{n}')" for a, n in skills.ALIASES.items())


@query(f"SELECT p_partkey, coalesce(n, trim(w)) AS skill FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' PySpark ' WHEN 1 THEN 'k8s' WHEN 2 THEN 'NodeJS' WHEN 3 THEN p_name ELSE 'C++' END AS w FROM part) LEFT JOIN (VALUES {ALIAS_ROWS}) a(k, n) ON k = lower(trim(w))")
def t1_alias_map(t: Tables) -> DataFrame:
    size = F.col("p_size") % 5
    word = F.when(size == 0, " PySpark ").when(size == 1, "k8s").when(size == 2, "NodeJS").when(size == 3, F.col("p_name")).otherwise("C++")
    return t.part.select("p_partkey", skills.normalize_skill(word).alias("skill"))


@query(
    """WITH p AS (SELECT l_orderkey AS job_id, lower(p_brand) AS k, arg_min(p_brand, (l_linenumber, l_partkey)) AS v, min((l_linenumber, l_partkey)) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT job_id, string_agg(v, ',' ORDER BY pos) AS skills FROM p GROUP BY job_id"""
)
def t2_ordered_dedup(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    lists = rows.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_brand"))).alias("x"))
    return lists.select("job_id", F.array_join(skills.normalize_skills(F.transform("x", lambda s: s["p_brand"])), ",").alias("skills"))


@query()
def t3_skill_scan(t: Tables) -> DataFrame:
    return t.postings.select("job_id", skills.scan_skills(F.concat_ws(" ", "title", "description")).alias("skills"))


@query()
def t3_dictionary(t: Tables) -> DataFrame:
    """Skills of descriptions by a join with the alias table; tags part words like blanks."""
    aliases = t.spark.createDataFrame(list(skills.ALIASES.items()), "alias string, value string")
    text = F.regexp_replace(F.regexp_replace("description", "<[^>]*>", " "), r"\.(?=\s|$)", " ")
    got = dictionary.longest_matches(t.postings.select("job_id", text.alias("text")), "job_id", "text", aliases)
    return got.select("job_id", "first", F.col("run").alias("alias"), F.col("value").alias("skill"))


@query()
def t4_skill_sections(t: Tables) -> DataFrame:
    text = F.concat("description", F.lit("\nNice to have: Docker, Kafka\nRequirements: SQL"))
    rows = skills.with_skills(t.postings, text, F.col("title"), F.array(F.lit("rest api")))
    return rows.select("job_id", "required", "preferred", F.when(F.size("required") > 0, 0.95).otherwise(0.5).alias("confidence"))


@query(r"SELECT job_id, regexp_matches(lower(description), '(^|[^a-z0-9])(golang|go)([^a-z0-9]|$)') AS has_go FROM postings", "postings")
def t6_skill_present(t: Tables) -> DataFrame:
    return t.postings.select("job_id", skills.is_present("Go", F.col("description")).alias("has_go"))


_TITLE = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"
for _p, _r in (
    (r"\bSDE[\s-]*1\b", "Software Development Engineer I"), (r"\bSDE[\s-]*I\b", "Software Development Engineer I"), (r"\bSDE[\s-]*2\b", "Software Development Engineer II"),
    (r"\bSDE\b", "Software Development Engineer"), (r"\bSWE\b", "Software Engineer"), (r"\bDev\b", "Developer"), (r"\bEngg\b", "Engineer"), (r"\bJr\.?\b", "Junior"), (r"\bSr\.?\b", "Senior"),
):
    _TITLE = f"regexp_replace({_TITLE}, '(?i){_p}', '{_r}', 'g')"


@query(f"SELECT job_id, {_TITLE} AS normalized_title FROM postings", "postings")
def t7_title(t: Tables) -> DataFrame:
    return t.postings.select("job_id", titles.normalize_title(F.col("title")).alias("normalized_title"))


@query(
    """SELECT title, count(*) AS n, any_value(CASE WHEN contains(lower(title), 'full stack') THEN 'FULL_STACK' WHEN contains(lower(title), 'genai') THEN 'GEN_AI'
      WHEN contains(lower(title), 'ml engineer') THEN 'ML_ENGINEERING' WHEN contains(lower(title), 'frontend') OR contains(lower(title), 'react') THEN 'FRONTEND'
      WHEN contains(lower(title), 'backend') THEN 'BACKEND' WHEN contains(lower(title), 'cloud engineer') THEN 'DEVOPS'
      WHEN contains(lower(title), 'data engineer') OR contains(lower(title), 'data analyst') THEN 'DATA' ELSE 'SOFTWARE_ENGINEERING' END) AS category FROM postings GROUP BY title""",
    "postings",
)
def t8_category(t: Tables) -> DataFrame:
    return t.postings.groupBy("title").agg(F.count("*").alias("n")).withColumn("category", titles.categorize_role(F.col("title")))


_SAL = r"""WITH s AS (SELECT job_id, replace(lower(trim(salary_raw)), ',', '') AS t FROM postings),
r AS (SELECT job_id, t, regexp_matches(t, 'unpaid') AS u,
  regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:-|to)?\s*(\d+(?:\.\d+)?)?\s*(?:cr|crore)', ['a', 'b']) AS c, regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:-|to)?\s*(\d+(?:\.\d+)?)?\s*(?:lpa|lakh|lac)', ['a', 'b']) AS l,
  regexp_extract(t, '(\d+)\s*(?:-|to)?\s*(\d+)?\s*(?:/month|per month|pm)', ['a', 'b']) AS m, regexp_extract(t, '(\d{5,8})\s*(?:-|to)?\s*(\d{5,8})?', ['a', 'b']) AS y FROM s),
v AS (SELECT job_id, u, CASE WHEN u THEN 0.0 WHEN c.a <> '' THEN try_cast(c.a AS DOUBLE) * 1e7 WHEN l.a <> '' THEN try_cast(l.a AS DOUBLE) * 1e5 WHEN m.a <> '' THEN try_cast(m.a AS DOUBLE) * 12 WHEN y.a <> '' THEN try_cast(y.a AS DOUBLE) END AS x,
  CASE WHEN u THEN 0.0 WHEN c.a <> '' THEN try_cast(coalesce(nullif(c.b, ''), c.a) AS DOUBLE) * 1e7 WHEN l.a <> '' THEN try_cast(coalesce(nullif(l.b, ''), l.a) AS DOUBLE) * 1e5
  WHEN m.a <> '' THEN try_cast(coalesce(nullif(m.b, ''), m.a) AS DOUBLE) * 12 WHEN y.a <> '' THEN try_cast(coalesce(nullif(y.b, ''), y.a) AS DOUBLE) END AS z FROM r)
SELECT job_id, least(x, z) AS salary_min, greatest(x, z) AS salary_max, coalesce(u, false) AS is_unpaid FROM v"""


@query(_SAL, "postings")
def t10_salary(t: Tables) -> DataFrame:
    got = amounts.parse_salary(F.col("salary_raw"))
    return t.postings.select("job_id", got["salary_min"].alias("salary_min"), got["salary_max"].alias("salary_max"), got["is_unpaid"].alias("is_unpaid"))


_EXP = """SELECT job_id, {low} AS exp_min, {high} AS exp_max, experience_raw AS exp_text,
  CASE WHEN experience_raw IN ('5 days a week', 'some experience') OR experience_raw IS NULL THEN 'LOW' ELSE 'HIGH' END AS confidence FROM postings""".format(
    low="CASE experience_raw WHEN '0-2 years' THEN 0 WHEN '3+ yrs' THEN 3 WHEN 'At least 2 years of experience' THEN 2 WHEN 'Fresher' THEN 0 WHEN 'Experience: 1-3' THEN 1 WHEN '4 years' THEN 4 WHEN 'exp 2' THEN 2 WHEN '2 to 5 yrs' THEN 2 END",
    high="CASE experience_raw WHEN '0-2 years' THEN 2 WHEN 'Fresher' THEN 0 WHEN 'Experience: 1-3' THEN 3 WHEN '4 years' THEN 4 WHEN 'exp 2' THEN 2 WHEN '2 to 5 yrs' THEN 5 END",
)


@query(_EXP, "postings")
def t11_experience(t: Tables) -> DataFrame:
    got = amounts.parse_experience(F.col("experience_raw"))
    return t.postings.select("job_id", *[got[c].alias(c) for c in ("exp_min", "exp_max", "exp_text", "confidence")])


@query(
    """SELECT job_id, CASE WHEN title = 'Principal Architect' THEN 7 WHEN title = 'Sr. Data Engineer' THEN 5 WHEN title = 'Cloud Engineer II' THEN 2 WHEN title IN ('Jr Frontend Dev', 'SDE-1  Backend') THEN 1
      WHEN title IN ('ML Engineer Intern', 'Data Analyst Trainee') THEN 0 END AS exp_min, title IN ('Principal Architect', 'Sr. Data Engineer', 'Engg Manager') AS senior FROM postings""",
    "postings",
)
def t12_title_level(t: Tables) -> DataFrame:
    return t.postings.select("job_id", titles.experience_from_title(F.col("title"))["exp_min"].alias("exp_min"), titles.is_senior_title(F.col("title")).alias("senior"))


@query(
    """SELECT location, count(*) AS n, any_value(CASE location WHEN 'Bangalore, Karnataka' THEN 'Bengaluru' WHEN 'Gurgaon or Noida' THEN 'Gurugram / Noida' WHEN 'BLR' THEN 'Bengaluru'
      WHEN 'Chennai, Pune, Kochi' THEN 'Chennai / Pune / Kochi' WHEN 'Pan India' THEN 'India' WHEN 'Work from home' THEN 'Remote' ELSE location END) AS normalized FROM postings GROUP BY location""",
    "postings",
)
def t14_location(t: Tables) -> DataFrame:
    return t.postings.groupBy("location").agg(F.count("*").alias("n")).withColumn("normalized", places.normalize_location(F.col("location")))


@query(
    """SELECT location, remote_type, count(*) AS n, any_value(remote_type = 'REMOTE' OR location IN ('Remote', 'Work from home', 'Gurgaon or Noida', 'Delhi NCR', 'Bangalore, Karnataka', 'BLR')) AS fits FROM postings GROUP BY location, remote_type""",
    "postings",
)
def f8_location_filter(t: Tables) -> DataFrame:
    wanted = F.concat(places.entities(F.lit("NCR / Karnataka")), places.entities(F.lit("Remote")))
    rows = t.postings.groupBy("location", "remote_type").agg(F.count("*").alias("n"))
    return rows.withColumn("fits", places.matches_criteria(places.entities(F.col("location")), F.col("remote_type"), wanted))


_AGO = {"Just now": 0, "5 minutes ago": 1 / 12, "3 hours ago": 3, "30 hours ago": 30, "Yesterday": 12, "2 days ago": 48, "few hours ago": 3, "an hour ago": 1, "Posted today": 0.5, "2001-08-02": 12, "2001-08-01": 20, "2001-07-20": 312, "half an hour ago": 0.5}
_LOW = ("30 hours ago", "2 days ago", "2001-07-20")


@query(
    f"SELECT job_id, epoch(TIMESTAMP '{NOW}')::BIGINT - CASE recency_raw {' '.join(f"WHEN '{k}' THEN {round(v * 3600)}" for k, v in _AGO.items())} END AS at, "
    f"CASE WHEN recency_raw IN ('2001-08-02', '2001-08-01') THEN 'MEDIUM' WHEN recency_raw IN {_LOW} OR recency_raw IN ('soon', '3 months ago') OR recency_raw IS NULL THEN 'LOW' ELSE 'HIGH' END AS confidence FROM postings",
    "postings",
)
def t17_recency(t: Tables) -> DataFrame:
    got = times.parse_recency(F.col("recency_raw"), clock(NOW))
    return t.postings.select("job_id", F.unix_seconds(got["ts"]).alias("at"), got["confidence"].alias("confidence"))


@query(
    r"""SELECT job_id, sha256(concat_ws('|', regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(location), '[^a-z0-9]', '', 'g'),
      regexp_replace(lower(employment_type), '[^a-z0-9]', '', 'g'), coalesce(regexp_replace(lower(source_job_id), '[^a-z0-9]', '', 'g'), 'generic'))) AS job_hash FROM postings""",
    "postings",
)
def t20_hash(t: Tables) -> DataFrame:
    return t.postings.select("job_id", identity.fingerprint(*[F.col(c) for c in ("company_name", "title", "location", "employment_type", "source_job_id")]).alias("job_hash"))


@query("SELECT job_id, coalesce(contains(application_url, 'acme'), false) AS direct FROM postings", "postings")
def t21_direct_url(t: Tables) -> DataFrame:
    return t.postings.select("job_id", identity.is_direct_url(F.col("application_url")).alias("direct"))


@query(
    r"SELECT job_id, coalesce(nullif(regexp_extract(url, 'urn:li:jobPosting:(\d+)', 1), ''), nullif(regexp_extract(url, '(\d{6,16})/?(?:\?.*)?$', 1), ''), nullif(regexp_extract(url, '(\d{6,16})', 1), '')) AS id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS plain FROM (SELECT job_id, 'https://x.example/jobs/' || (1000000 + job_id) || CASE WHEN job_id % 2 = 0 THEN '/?ref=1#a' ELSE '-dev' END AS url FROM postings)",
    "postings",
)
def t29_external_id(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://x.example/jobs/"), (F.lit(1000000) + F.col("job_id")).cast("string"), F.when(F.col("job_id") % 2 == 0, "/?ref=1#a").otherwise("-dev"))
    return t.postings.select("job_id", identity.external_id(url).alias("id"), identity.canonical_url(url).alias("plain"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \t\r\n\x0b\x0c]+', ' ', 'g')) AS text FROM pages")
def t30_strip_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.strip_tags(F.col("html")).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def t31_clean_values(t: Tables) -> DataFrame:
    third = F.col("event_id") % 9
    kind = F.when(third == 0, " NaN ").when(third == 3, "  ").when(third == 6, "null").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\t")))
    value = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    return t.events.select("event_id", identity.clean_text(kind).alias("kind"), identity.clean_number(value).alias("value"))


@query("SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events")
def t32_json_repair(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("Sure! ```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` done"))
    return t.events.select("event_id", F.get_json_object(markup.repair_json(noisy), "$.k").cast("int").alias("k"))


@query("SELECT job_id, CASE WHEN description = 'short' THEN 0 ELSE 3 END AS n, description = 'short' AS kept FROM postings", "postings")
def t33_metrics(t: Tables) -> DataFrame:
    lost = F.replace(F.col("description"), F.lit("25%"), F.lit("a lot"))
    return t.postings.select("job_id", F.size(markup.metrics(F.col("description"))).alias("n"), markup.keeps_metrics(F.col("description"), lost).alias("kept"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '***' ELSE substr(c_name, 1, 3) || '...' || right(c_name, 4) END AS masked FROM customer")
def t35_mask(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", identity.mask_secret(F.when(F.col("c_custkey") % 2 == 0, F.substring("c_name", 1, 7)).otherwise(F.col("c_name"))).alias("masked"))


@query("WITH s AS (SELECT job_id, string_agg(lower(skill), ',' ORDER BY lower(skill)) AS k FROM posting_skills GROUP BY job_id) SELECT k AS skills, count(*) AS n FROM s GROUP BY k", "posting_skills")
def t37_versions(t: Tables) -> DataFrame:
    lists = t.posting_skills.groupBy("job_id").agg(F.shuffle(F.collect_list("skill"), 7).alias("skills"))
    low = identity.sorted_low(F.col("skills"))
    rows = lists.select(identity.version(low).alias("version"), F.array_join(low, ",").alias("skills"))
    return rows.groupBy("version").agg(F.min("skills").alias("skills"), F.count("*").alias("n")).drop("version")


_PATTERNS = {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "hex40": r"[0-9a-f]{40}", "card": r"[0-9]{16}"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{p}')) FROM documents)" for k, p in _PATTERNS.items()))
def t42_secret_scan(t: Tables) -> DataFrame:
    counts = [F.sum(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).alias(k) for k, p in _PATTERNS.items()]
    row = t.documents.agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k in _PATTERNS])).alias("x")).select("x.pattern", "x.n")


_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS s FROM documents) WHERE NOT regexp_matches(lower(s), '{'|'.join(findings.DUMMIES)}')"
    for kind, pattern in {**findings.SECRETS, **_PATTERNS}.items()
)


@query(f"SELECT doc_id, kind, CASE WHEN length(s) > 10 THEN s[1:6] || '...' || s[-4:] ELSE '***' END AS masked FROM ({_FOUND})")
def t42_findings(t: Tables) -> DataFrame:
    """Every secret, address and card number of every document, masked."""
    found = findings.secret_findings(F.col("text"), {**findings.SECRETS, **_PATTERNS})
    return t.documents.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", "f.masked")


@query("SELECT page_id, CASE WHEN contains(lower(html), 'captcha') OR contains(lower(html), 'enable javascript') THEN 'VERIFY_OR_CAPTCHA' END AS state FROM pages")
def s9_block_class(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.block_state(F.col("html")).alias("state"))


@query("SELECT event_id, event_type AS title, user_id::VARCHAR AS company_name, 'Pune, IN' AS location, value::DOUBLE AS salary_min, 'MONTH' AS salary_period, 2 AS n_skills FROM events")
def s11_job_posting(t: Tables) -> DataFrame:
    ld = F.concat(
        F.lit('<html><script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["JobPosting"], "title": "'), "event_type", F.lit('", "hiringOrganization": {"name": "'), F.col("user_id").cast("string"),
        F.lit('"}, "jobLocation": [{"address": {"addressLocality": "Pune", "addressCountry": "IN"}}], "baseSalary": {"value": {"minValue": '), F.col("value").cast("string"), F.lit(', "unitText": "month"}}, "skills": "a, b",}]}</script></html>'),
    )
    got = t.events.select("event_id", markup.job_posting(ld).alias("j"))
    return got.select("event_id", *[F.col(f"j.{c}") for c in ("title", "company_name", "location", "salary_min", "salary_period")], F.size("j.skills").alias("n_skills"))


@query("SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events")
def s6_next_data(t: Tables) -> DataFrame:
    page = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": '), "props", F.lit("}}</script>"))
    return t.events.select("event_id", markup.next_data(page, "$.props.other.k", "$.props.pageProps.k").cast("int").alias("k"))


@query("SELECT event_id, (json_extract(props, '$.k'))::INT AS k, 2 + (event_id % 2) AS nodes FROM events")
def s10_json_props(t: Tables) -> DataFrame:
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    listed = block(F.concat(F.lit("["), "props", F.lit(', {"@type": "Other"}]')))
    more = F.when(F.col("event_id") % 2 == 1, block(F.lit('{"@graph": [{"a": 1,}]}'))).otherwise(block(F.lit("{broken")))
    nodes = markup.json_ld_blocks(F.concat(F.lit("<html>"), listed, more))
    return t.events.select("event_id", F.try_variant_get(F.get(nodes, 0), "$.k", "int").alias("k"), F.size(nodes).cast("long").alias("nodes"))


@query()
def s13_page_text(t: Tables) -> DataFrame:
    got = markup.page_text(F.col("html"))
    rows = t.pages.select("page_id", got.alias("x"))
    return rows.select("page_id", "x.text", "x.has_form", markup.is_closed(F.col("x.text")).alias("is_closed"))


def _first_of(key: str) -> str:
    return f"SELECT first AS earlier, job_id AS later FROM (SELECT job_id, min(job_id) OVER (PARTITION BY {key}) AS first FROM postings WHERE {key} <> '') WHERE first < job_id"


@query(f"SELECT 'source' AS url, * FROM ({_first_of('source_url')}) UNION ALL SELECT 'application' AS url, * FROM ({_first_of('application_url')})", "postings")
def d1_exact_dup(t: Tables) -> DataFrame:
    rows = t.postings.withColumnRenamed("job_id", "pos")
    level = "LEVEL_1_EXACT_URL"
    found = [dedup.chained_edges(rows, key, level).select(F.lit(url).alias("url"), "earlier", "later") for url, key in zip(("source", "application"), dedup.exact_keys()[level])]
    return found[0].unionByName(found[1])


@query("SELECT a.job_id AS earlier, b.job_id AS later FROM (SELECT source, source_job_id, min(job_id) AS job_id FROM postings WHERE source_job_id IS NOT NULL GROUP BY 1, 2) a JOIN postings b USING (source, source_job_id) WHERE a.job_id < b.job_id", "postings")
def d2_key_dup(t: Tables) -> DataFrame:
    key = dedup.exact_keys()["LEVEL_2_SOURCE_JOB_ID"][0]
    return dedup.chained_edges(t.postings.withColumnRenamed("job_id", "pos"), key, "LEVEL_2_SOURCE_JOB_ID").select("earlier", "later")


_CLEAN = lambda c: f"coalesce(regexp_replace(lower(nullif({c}, '')), '[^a-z0-9]', '', 'g'), 'generic')"
_META = f"sha256(concat_ws('|', {_CLEAN("lower(company_name || '/' || location)")}, {_CLEAN('lower(title)')}, {_CLEAN('location')}, {_CLEAN('employment_type')}, {_CLEAN('source_job_id')}))"


@query(f"SELECT first AS earlier, job_id AS later FROM (SELECT job_id, min(job_id) OVER (PARTITION BY h) AS first FROM (SELECT job_id, {_META} AS h FROM postings)) WHERE first < job_id", "postings")
def d3_hash_dup(t: Tables) -> DataFrame:
    level = "LEVEL_3_NORMALIZED_METADATA"
    return dedup.chained_edges(fold_rows(t), dedup.exact_keys()[level][0], level).select("earlier", "later")


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s]+'), lambda w: w <> ''))"


_NEAR = f"""d AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), w AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS w FROM d),
    p AS (SELECT a.doc_id AS earlier, b.doc_id AS later, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
    j AS (SELECT earlier, later, round(c / (n + m - c)::DOUBLE, 6) AS jaccard FROM p WHERE c / (n + m - c)::DOUBLE >= 0.85),
    k AS (SELECT d.doc_id, coalesce(min(earlier) FILTER (jaccard = 1), d.doc_id) AS class FROM d LEFT JOIN j ON d.doc_id = j.later WHERE len(ts) > 0 GROUP BY d.doc_id)"""


@query(
    f"""WITH {_NEAR}, e AS (SELECT earlier AS x FROM j UNION ALL SELECT later FROM j), n AS (SELECT x, count(*) AS n FROM e GROUP BY x),
    c AS (SELECT least(a.class, b.class) AS x, greatest(a.class, b.class) AS y, any_value(jaccard) AS jaccard FROM j JOIN k a ON j.earlier = a.doc_id JOIN k b ON j.later = b.doc_id WHERE a.class <> b.class GROUP BY 1, 2),
    l AS (SELECT x, string_agg(y || ':' || jaccard, ' ' ORDER BY y) AS links FROM c GROUP BY x)
    SELECT k.doc_id, class, count(*) OVER (PARTITION BY class) AS class_size, coalesce(n, 0) AS n_links, coalesce(links, '') AS links FROM k LEFT JOIN n ON k.doc_id = n.x LEFT JOIN l ON k.doc_id = l.x"""
)
def d4_near_dup(t: Tables) -> DataFrame:
    """One row per document that has a token: its class of equal token sets, how many documents are near it, and in its class's first row the later classes that are near, each with its Jaccard."""
    rows, pairs = near_documents(t)
    return told_links(rows, pairs, F.round("jaccard", 6)).withColumnRenamed("pos", "doc_id")


@query(f"WITH {_NEAR} SELECT least(a.class, b.class) AS earlier, greatest(a.class, b.class) AS later, any_value(jaccard) AS jaccard, count(*) AS pairs FROM j JOIN k a ON j.earlier = a.doc_id JOIN k b ON j.later = b.doc_id WHERE a.class <> b.class GROUP BY 1, 2")
def d4_class_pairs(t: Tables) -> DataFrame:
    """Near classes of documents, by their smallest doc_id, and the pairs of documents that they stand for."""
    _, pairs = near_documents(t)
    return pairs.select(F.least("a", "b").alias("earlier"), F.greatest("a", "b").alias("later"), F.round("jaccard", 6).alias("jaccard"), (F.col("a_size") * F.col("b_size")).alias("pairs"))


def told_links(rows: DataFrame, pairs: DataFrame, *values: Column) -> DataFrame:
    """rows (pos, class, class_size, n_links) with links: every pair of classes once, in the first row of the earlier class, as the later class's number and what is told of the pair."""
    later = F.struct(F.greatest("a", "b").alias("y"), F.concat_ws(":", F.greatest("a", "b"), *values).alias("told"))
    lists = pairs.groupBy(F.least("a", "b").alias("pos")).agg(F.array_join(F.sort_array(F.collect_list(later))["told"], " ").alias("links"))
    return rows.join(lists, "pos", "left").select("pos", "class", "class_size", "n_links", F.coalesce("links", F.lit("")).alias("links"))


def near_documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    members, near = dedup.near_classes(t.documents.select(F.col("doc_id").alias("pos"), "text"), 85)
    return dedup.class_links(members, "set_id", near, F.col("jaccard"))


def near_vectors(t: Tables) -> DataFrame:
    """Every vector, and a near copy of it that lacks the first component."""
    rows = t.embeddings.select(F.col("vec_id").cast("long").alias("pos"), F.col("label").cast("string").alias("block"), F.col("embedding").cast("array<double>").alias("embedding"))
    cut = F.transform("embedding", lambda x, i: F.when(i == 0, 0.0).otherwise(x))
    return rows.unionByName(rows.select((F.col("pos") + 1_000_000_000).alias("pos"), "block", cut.alias("embedding")))


_VECTORS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), v AS (SELECT * FROM e UNION ALL SELECT vec_id + 1000000000, label, list_concat([0.0::DOUBLE], e[2:]) FROM e),
    p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.92),
    k AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY label, e) AS class, count(*) OVER (PARTITION BY label, e) AS class_size FROM v)"""


@query(
    f"""WITH {_VECTORS}, n AS (SELECT x, count(*) AS n FROM p GROUP BY x), c AS (SELECT DISTINCT a.class AS x, b.class AS y FROM p JOIN k a ON x = a.vec_id JOIN k b ON y = b.vec_id WHERE a.class < b.class),
    l AS (SELECT x, string_agg(y, ' ' ORDER BY y) AS links FROM c GROUP BY x)
    SELECT vec_id, class, class_size, coalesce(n, 0) AS n_links, coalesce(links, '') AS links FROM k LEFT JOIN n ON vec_id = n.x LEFT JOIN l ON vec_id = l.x"""
)
def d5_vector_dup(t: Tables) -> DataFrame:
    """One row per vector: its class of equal vectors, how many vectors of its block are near it, and in its class's first row the later classes that are near. A vector without a block is near none."""
    every = cut_lineage(near_vectors(t))
    members, similar = dedup.vector_classes(every)
    rows, pairs = dedup.class_links(members, "class", similar)
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    alone = every.filter(F.col("block").isNull() | (size <= 0)).select("pos", F.xxhash64(F.coalesce("block", F.lit("")), size, "embedding").alias("class"))
    alone = dedup.sized_classes(alone).withColumn("n_links", F.lit(0).cast("long"))
    return told_links(rows.unionByName(alone), pairs).withColumnRenamed("pos", "vec_id")


@query(f"WITH {_VECTORS} SELECT a.class AS earlier, b.class AS later, count(*) AS pairs FROM p JOIN k a ON x = a.vec_id JOIN k b ON y = b.vec_id WHERE a.class < b.class GROUP BY 1, 2")
def d5_class_pairs(t: Tables) -> DataFrame:
    members, similar = dedup.vector_classes(near_vectors(t))
    _, pairs = dedup.class_links(members, "class", similar)
    return pairs.select(F.least("a", "b").alias("earlier"), F.greatest("a", "b").alias("later"), (F.col("a_size") * F.col("b_size")).alias("pairs"))


_KEYED = f"""k AS (SELECT job_id AS pos, unnest(list_filter(['s' || nullif(source_url, 'ftp://bad'), 'a' || application_url, 'i' || source || chr(31) || source_job_id, 'm' || {_META}], lambda x: x IS NOT NULL)) AS key FROM postings),
    e AS (SELECT DISTINCT pos AS a, min(pos) OVER (PARTITION BY key) AS b FROM k), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)"""


@query(
    f"""WITH RECURSIVE {_KEYED}, r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a)
    SELECT node, min(root) AS root FROM r GROUP BY node""",
    "postings",
)
def d6_components(t: Tables) -> DataFrame:
    return dedup.components(dedup.key_edges(fold_rows(t)))


def fold_rows(t: Tables) -> DataFrame:
    return t.postings.select(
        F.col("job_id").alias("pos"), "source", "source_job_id", F.lower(F.concat_ws("/", "company_name", "location")).alias("normalized_company"), F.lower("title").alias("normalized_title"), F.col("location").alias("normalized_location"),
        "employment_type", F.nullif(F.col("source_url"), F.lit("ftp://bad")).alias("source_url"), "application_url", "description", "posted_at", "title",
    )


@query()
def d6_fold(t: Tables) -> DataFrame:
    return dedup.deduplicate(fold_rows(t))


@query()
def d8_merged_sources(t: Tables) -> DataFrame:
    rows = fold_rows(t)
    got = dedup.merged_sources(rows, dedup.deduplicate(rows))
    return got.select("pos", F.size("other_sources").alias("n"), F.array_join(F.transform("other_sources", lambda s: F.concat_ws(" ", s["source"], s["source_url"])), "\n").alias("other_sources"))


@query()
def d9_merge_audit(t: Tables) -> DataFrame:
    rows = fold_rows(t)
    return dedup.merge_audit(rows, dedup.deduplicate(rows))


@query()
def d10_staged(t: Tables) -> DataFrame:
    """Two passes; the stand-in's postings have the vector of their number, where there is one."""
    vectors = t.embeddings.select(F.col("vec_id").cast("long").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    return dedup.deduplicate_in_stages(fold_rows(t).join(vectors, "pos", "left"))


def head_documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    """members (pos, class) and ratios (later, earlier, similarity) of classes of documents whose token sets have a Jaccard of 0.65 or more."""
    return dedup.head_classes(*dedup.near_classes(t.documents.select(F.col("doc_id").alias("pos"), "text"), round(100 * dedup.PREFILTER), keep_heads=True))


@query()
def t22_sequence_ratio(t: Tables) -> DataFrame:
    """Both ratios of every two classes (equal heads in one token set), named by their smallest doc_id, with their sizes. Within a class it is 1."""
    members, ratios = head_documents(t)
    pairs = dedup.class_links(members, "class", ratios.withColumnsRenamed({"later": "a", "earlier": "b"}), F.round("similarity", 6).alias("similarity"))[1]
    return pairs.withColumnsRenamed({"a": "later", "b": "earlier", "a_size": "later_size", "b_size": "earlier_size"})


@query()
def t22_classes(t: Tables) -> DataFrame:
    """The class of every document that has a token, which asks for no pair."""
    hashed = dedup.token_hashes(t.documents.select(F.col("doc_id").cast("long").alias("pos"), "text"))
    return dedup.sized_classes(cut_lineage(dedup.head_keys(hashed).select("pos", "class"))).select(F.col("pos").alias("doc_id"), "class", "class_size")


def query_vector(t: Tables, vec_id: int) -> Column:
    """One stored vector as a parameter; null, which nothing is similar to, if it is not there."""
    found = t.embeddings.filter(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return F.array(*map(F.lit, found[0]["embedding"])) if found else F.lit(None).cast("array<double>")


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20"""
)
def o9_semantic_topk(t: Tables) -> DataFrame:
    score = vectors.cosine(F.col("embedding"), query_vector(t, 7))
    return t.embeddings.withColumn("s", score).orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 4).alias("similarity"))


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)
    SELECT vec_id, round(greatest(0.0, least(100.0, (list_cosine_similarity(embedding::DOUBLE[], q) - 0.3) / (0.85 - 0.3)::DOUBLE * 100)), 1) AS score FROM embeddings, q"""
)
def c3_semantic_score(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", vectors.semantic_score(F.col("embedding"), query_vector(t, 3)).alias("score"))
