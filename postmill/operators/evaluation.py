"""Candidates against postings: every dimension, gates, class and reasons, and a cache of matches by version.

Candidates are few and known when the query is planned (their number is checked), so the postings are read once and each
gives one row per candidate; nothing is joined or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places, profile, scoring, titles
from ..functions.amounts import is_unpaid
from ..functions.base import any_in
from ..sources.snapshots import Store
from .keyed import cached_or_missing
from .tables import cut_lineage

#: Version of the scoring rules: a part of what a cached match depends on.
ALGORITHM = "v2.1"
# Names of one metro that stand for each other.
NCR = ["delhi", "noida", "gurgaon", "gurugram", "delhi ncr", "greater noida", "ghaziabad", "faridabad"]


@dataclass(frozen=True)
class Candidate:
    profile_id: int
    skills: list[str]
    experience_years: int = 0
    target_roles: list[str] = field(default_factory=list)
    excluded_roles: list[str] = field(default_factory=list)
    preferred_locations: list[str] = field(default_factory=list)
    remote_preference: bool = True
    internship_allowed: bool = True
    minimum_salary_lpa: float | None = None
    priority_companies: list[str] = field(default_factory=list)
    excluded_companies: list[str] = field(default_factory=list)
    experience_ceiling: int = 2
    exclude_unpaid: bool = False
    version: str = ""
    preference_version: str = ""


def candidates_of(rows: DataFrame, most: int = 32) -> list[Candidate]:
    """Candidates from a table with their fields as columns; missing columns and nulls take the defaults."""
    found = rows.orderBy("profile_id").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} candidates at once")
    known = Candidate.__dataclass_fields__
    return [Candidate(**{k: v for k, v in r.asDict().items() if k in known and v is not None}) for r in found]


def outside(c: Candidate) -> Column:
    """The posting is at none of the preferred places. Remote ones are wherever the candidate works remotely."""
    wanted = [p.strip().lower() for p in c.preferred_locations if p.strip()]
    if not wanted:
        return F.lit(False)
    names = wanted + (NCR if set(wanted) & set(NCR) else [])
    here = any_in(F.lower(F.coalesce("location", F.lit(""))), names) | any_in(F.lower(F.coalesce("normalized_location", F.lit(""))), names)
    remote = F.upper(F.coalesce("remote_type", F.lit(""))) == "REMOTE"
    return F.when(remote, F.lit(not c.remote_preference)).otherwise(~here)


def with_parts(jobs: DataFrame, candidates: list[Candidate], transfer=scoring.TRANSFER, canonical: bool = True) -> DataFrame:
    """jobs with the parts of each candidate's evaluation in columns of their own, step by step: what is read several times is worked out once.

    jobs: the columns of a posting, with role_category, normalized_location, required_skills and preferred_skills.
    """
    names = lambda i: {x: f"__{x}{i}" for x in ("wanted", "compat", "role", "preference", "location", "overall")}
    steps: list[dict[str, Column]] = [{"__found": places.entities(F.coalesce("normalized_location", "location"))}, {}, {}]
    for i, c in enumerate(candidates):
        n = names(i)
        if c.preferred_locations:
            steps[0][n["wanted"]] = F.flatten(F.array(*[places.entities(F.lit(p)) for p in c.preferred_locations]))
        steps[0][n["compat"]] = scoring.skill_compatibility(c.skills, F.col("required_skills"), F.col("preferred_skills"), transfer, canonical)
        steps[0][n["role"]] = scoring.role_score(F.col("title"), F.col("role_category"), c.target_roles, c.excluded_roles)
        steps[0][n["preference"]] = scoring.preference_score(F.col("company_name"), F.col("salary_max"), c.minimum_salary_lpa, c.priority_companies, c.excluded_companies)
        steps[1][n["location"]] = location_of(c, F.col("__found"), F.col(n["wanted"])).cast("double")
        compat = F.col(n["compat"])
        parts = [F.round(compat[x], 1) for x in ("required_score", "preferred_score", "transferable_score")]
        raw = scoring.weighted(*parts, experience_of(c), F.col(n["location"]), F.col(n["preference"])["score"])
        steps[2][n["overall"]] = scoring.gated(raw, compat, titles.matches_target_role(F.col("title"), c.target_roles))
    for step in steps:
        jobs = jobs.withColumns(step)
    return jobs


def experience_of(c: Candidate) -> Column:
    return scoring.experience_score(c.experience_years, F.col("experience_min"), F.col("experience_max"), F.col("employment_type"), c.internship_allowed).cast("double")


def location_of(c: Candidate, found: Column, wanted: Column) -> Column:
    none = F.array().cast("array<string>")
    if not c.preferred_locations:
        return scoring.location_score(F.lit(False), none, none, F.col("remote_type"), [], False, c.remote_preference)
    states = lambda items: F.array_compact(F.transform(items, lambda e: e["state_or_ut"]))
    return scoring.location_score(places.matches_criteria(found, F.col("remote_type"), wanted), F.transform(found, lambda e: e["name"]), states(found), F.col("remote_type"), states(wanted), True, c.remote_preference)


def evaluation(c: Candidate, i: int) -> Column:
    """struct of everything about the i-th candidate and a posting, from the columns of with_parts."""
    compat, role, preference, overall = (F.col(f"__{x}{i}") for x in ("compat", "role", "preference", "overall"))
    unpaid = F.lit(c.exclude_unpaid) & (F.coalesce((F.col("salary_max") == 0) & (F.col("salary_min") == 0), F.lit(False)) | is_unpaid(F.col("salary_raw")))
    reasons = profile.exclusion_reasons(c.experience_ceiling, unpaid, outside(c), role["excluded"], preference["excluded"])
    n_preferred = F.size(F.coalesce("preferred_skills", F.array().cast("array<string>")))
    sure = scoring.confidence(compat["n_required"], n_preferred, F.col("experience_min"), F.col("experience_max"), F.col("employment_type"), F.col("experience_confidence"), F.col("description_confidence"), F.length(F.coalesce("description", F.lit(""))))
    return F.struct(
        F.lit(c.profile_id).alias("profile_id"), F.lit(c.version).alias("profile_version"), overall.alias("overall_score"), compat["skill_score"].alias("skill_score"), experience_of(c).alias("experience_score"), F.col(f"__location{i}").alias("location_score"),
        preference["score"].cast("double").alias("preference_score"), role["score"].cast("double").alias("role_score"), scoring.recommendation(overall).alias("recommendation"), scoring.verdict(overall).alias("verdict"), sure["confidence"].alias("confidence"), sure["label"].alias("confidence_label"),
        compat["matched"].alias("matched"), compat["missing"].alias("missing"), reasons.alias("exclusion_reasons"), scoring.explanation(overall, compat).alias("explanation"),
    )


def evaluate(jobs: DataFrame, candidates: list[Candidate], key: str = "job_id", fields: list[str] | None = None, **how) -> DataFrame:
    """key and one evaluation per candidate and posting; with fields only these, since nothing behind an explode is pruned: the rest would be worked out."""
    told = lambda e: e if fields is None else F.struct(*[e[f].alias(f) for f in fields])
    each = F.explode(F.array(*[told(evaluation(c, i)) for i, c in enumerate(candidates)])).alias("e")
    return with_parts(jobs, candidates, **how).select(key, each).select(key, "e.*")


#: What a cached match is kept by, what it depends on, and what it keeps.
KEYS, VERSIONS = ["job_id", "profile_id"], ["job_version", "profile_version", "preference_version", "algorithm"]
KEPT = ["overall_score"]


def evaluate_cached(jobs: DataFrame, candidates: list[Candidate], cache: DataFrame, **how) -> DataFrame:
    """Keys, overall_score, versions and hit, one row per posting and candidate: the newest cached match of both if all versions are equal, else scored now.

    jobs have a job_version. cache: keys, versions, overall_score, calculated_at; rows of other candidates, stale and repeated ones do no harm.
    """
    told = F.explode(F.array(*[F.struct(F.lit(c.profile_id).cast("long").alias("profile_id"), F.lit(c.version).alias("profile_version"), F.lit(c.preference_version).alias("preference_version")) for c in candidates]))
    asked = jobs.select("job_id", "job_version", told.alias("c")).select("job_id", "job_version", "c.*", F.lit(ALGORITHM).alias("algorithm"))
    marked = cached_or_missing(asked, cache, KEYS, VERSIONS, ["calculated_at"], KEPT)
    columns = [*KEYS, *KEPT, *VERSIONS, "hit"]
    missing = marked.filter(~F.col("hit")).drop(*KEPT)
    # Only postings that some candidate misses are scored.
    scored = evaluate(jobs.join(missing.select("job_id").distinct(), "job_id", "left_semi"), candidates, fields=["profile_id", *KEPT], **how).select("job_id", F.col("profile_id").cast("long").alias("profile_id"), *KEPT)
    return marked.filter("hit").select(columns).unionByName(missing.join(scored, KEYS).select(columns))


def store_misses(store: Store, evaluated: DataFrame, at: Column) -> None:
    """Writes what was scored now into the stored cache, one row per posting and candidate, and leaves the rest."""
    missed = evaluated.filter(~F.col("hit")).select(*KEYS, *KEPT, *VERSIONS, at.alias("calculated_at"))
    store.merge(cut_lineage(missed), lambda old, new: old.join(new.select(*KEYS), KEYS, "left_anti").unionByName(new.select(old.columns)))
