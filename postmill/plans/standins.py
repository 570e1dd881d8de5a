"""Postings and their companions derived from the warehouse tables, in SQL that any engine here runs.

The warehouse has no postings, so each order becomes one: its customer is the company, its date the posting time, its
keys choose among raw texts of the kinds that the text functions must read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import expect_inflation

NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"

POSTINGS = """
SELECT o_orderkey AS job_id, o_custkey AS company_id,
  CASE o_custkey % 5 WHEN 0 THEN 'north' WHEN 1 THEN 'East' WHEN 2 THEN 'west' WHEN 3 THEN 'south' ELSE 'sample' END AS source,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('J', CAST(o_orderkey % 9000 AS STRING)) END AS source_job_id,
  CASE o_orderkey % 14 WHEN 0 THEN 'SDE-1  Backend' WHEN 1 THEN 'Sr. Data Engineer' WHEN 2 THEN 'Jr Frontend Dev' WHEN 3 THEN 'Full Stack Developer'
    WHEN 4 THEN 'GenAI Engineer' WHEN 5 THEN 'ML Engineer Intern' WHEN 6 THEN 'Cloud Engineer II' WHEN 7 THEN 'SWE' WHEN 8 THEN 'React UI Developer'
    WHEN 9 THEN 'Principal Architect' WHEN 10 THEN 'Data Analyst Trainee' WHEN 11 THEN 'Engg Manager' WHEN 12 THEN 'QA' ELSE 'Software Engineer - Early Career' END AS title,
  c_name AS company_name, c_mktsegment AS segment,
  CASE (o_orderkey + o_custkey) % 12 WHEN 0 THEN 'Bangalore, Karnataka' WHEN 1 THEN 'Pune / Mumbai' WHEN 2 THEN 'Remote' WHEN 3 THEN 'Gurgaon or Noida'
    WHEN 4 THEN 'BLR' WHEN 5 THEN 'Hyderabad' WHEN 6 THEN 'Delhi NCR' WHEN 7 THEN 'Tamil Nadu' WHEN 8 THEN 'Chennai, Pune, Kochi' WHEN 9 THEN 'Pan India'
    WHEN 10 THEN 'Work from home' ELSE 'Springfield' END AS location,
  CASE WHEN o_orderkey % 7 = 0 THEN 'REMOTE' WHEN o_orderkey % 7 < 3 THEN 'HYBRID' ELSE 'ONSITE' END AS remote_type,
  CASE WHEN o_orderkey % 14 IN (5, 10) THEN 'INTERNSHIP' ELSE 'FULL_TIME' END AS employment_type,
  CASE o_custkey % 11 WHEN 0 THEN '0-2 years' WHEN 1 THEN '3+ yrs' WHEN 2 THEN 'At least 2 years of experience' WHEN 3 THEN 'Fresher' WHEN 4 THEN '5 days a week'
    WHEN 5 THEN 'Experience: 1-3' WHEN 6 THEN '4 years' WHEN 7 THEN NULL WHEN 8 THEN 'exp 2' WHEN 9 THEN 'some experience' ELSE '2 to 5 yrs' END AS experience_raw,
  CASE o_custkey % 9 WHEN 0 THEN concat(CAST(4 + o_orderkey % 20 AS STRING), '-', CAST(6 + o_orderkey % 20 AS STRING), ' LPA') WHEN 1 THEN '25,000 per month'
    WHEN 2 THEN 'Unpaid' WHEN 3 THEN '1.2 Cr' WHEN 4 THEN '450000-600000' WHEN 5 THEN NULL WHEN 6 THEN '12 lakh' WHEN 7 THEN '15000 - 20000 /month' ELSE 'competitive' END AS salary_raw,
  CASE o_orderkey % 16 WHEN 0 THEN 'Just now' WHEN 1 THEN '5 minutes ago' WHEN 2 THEN '3 hours ago' WHEN 3 THEN '30 hours ago' WHEN 4 THEN 'Yesterday' WHEN 5 THEN '2 days ago'
    WHEN 6 THEN '3 months ago' WHEN 7 THEN 'few hours ago' WHEN 8 THEN 'an hour ago' WHEN 9 THEN 'Posted today' WHEN 10 THEN '2001-08-02' WHEN 11 THEN '2001-08-01'
    WHEN 12 THEN '2001-07-20' WHEN 13 THEN NULL WHEN 14 THEN 'half an hour ago' ELSE 'soon' END AS recency_raw,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS posted_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'LOW' END AS posted_at_confidence,
  o_orderstatus <> 'P' AS is_active,
  CASE WHEN o_orderkey % 23 = 0 THEN 'ftp://bad' ELSE concat('https://jobs.example.com/', CAST(o_orderkey % 9000 AS STRING)) END AS source_url,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('https://linkedin.com/jobs/', CAST(o_orderkey AS STRING)) ELSE concat('https://acme.example/careers/', CAST(o_orderkey AS STRING)) END AS application_url,
  CASE WHEN o_orderkey % 31 = 0 THEN 'short' ELSE concat('<p>Work on <b>', c_mktsegment, '</b> systems with ', CASE o_orderkey % 4 WHEN 0 THEN 'Python and SQL' WHEN 1 THEN 'React' WHEN 2 THEN 'Java, Docker' ELSE 'Go' END,
    '.</p> Grew revenue 25% to $3.5M across ', CAST(o_orderkey % 50 AS STRING), ' teams.') END AS description,
  CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 7 END AS experience_min,
  CASE o_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN NULL ELSE 9 END AS experience_max,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN 0.0E0 ELSE o_totalprice * 2 END AS salary_min,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN 0.0E0 ELSE o_totalprice * 3 END AS salary_max,
  CAST(o_orderkey % 100 AS DOUBLE) AS quality_score
FROM orders JOIN customer ON o_custkey = c_custkey"""

#: Required skills of a posting: the kinds of part on its order; preferred: their brands.
SKILLS = """
SELECT l_orderkey AS job_id, p_type AS skill, min(l_linenumber) AS at
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_type"""

SAVED = """
SELECT user_id % 3 AS user_id, event_id % 15000 AS job_id,
  CASE event_type WHEN 'view' THEN 'VIEWED' WHEN 'click' THEN 'SAVED' WHEN 'purchase' THEN 'APPLIED' WHEN 'signup' THEN 'INTERVIEW' ELSE 'IGNORED' END AS status,
  ts AS updated_at, event_id
FROM events"""

MATCHES = """
SELECT event_id AS match_id, event_id % 7500 AS job_id, user_id % 2 AS profile_id, value AS overall_score, CAST(user_id % 4 AS STRING) AS job_version, ts AS calculated_at
FROM events"""

VIEWS = {"postings": POSTINGS, "posting_skills": SKILLS, "saved_jobs": SAVED, "matches": MATCHES}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def clock(now: str) -> Column:
    """A fixed instant; made when a query is planned, never on import."""
    return F.lit(now).cast("timestamp_ntz")


class Tables:
    """Tables of one folder and the views made of them, as DataFrames; nothing is registered under a shared name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        expect_inflation(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(VIEWS[name])
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, sql: str) -> DataFrame:
        """Runs sql with {table} in place of table names that follow FROM or JOIN."""
        import re

        used = {t for t in re.findall(r"(?:FROM|JOIN) (\w+)", sql) if t in TABLES}
        named = re.sub(r"(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
        return self.spark.sql(named, **{t: getattr(self, t) for t in used})


def oracle(body: str, *views: str) -> str:
    """SQL with the named views as common table expressions before it."""
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = body.strip()
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head}, {body[len(start):]}"
    return f"WITH {head} {body}"
