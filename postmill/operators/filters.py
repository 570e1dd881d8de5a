"""Predicates over postings as boolean columns, each with the null rules of its definition."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import is_unpaid
from ..functions.base import first_true, strip

#: Statuses that take a posting out of the feed.
SEARCH_EXCLUDES = ["SAVED", "PREPARING", "READY_TO_APPLY", "APPLIED", "INTERVIEW", "OFFER", "REJECTED", "IGNORED"]
FACET_EXCLUDES = ["SAVED", "APPLIED", "INTERVIEW", "OFFER", "REJECTED", "IGNORED"]


def fresh(now: Column, hours: float) -> Column:
    """On raw columns, so that it reaches the scan."""
    cutoff = now - F.make_dt_interval(hours=F.lit(int(hours)))
    return F.col("is_active") & F.col("posted_at").isNotNull() & (F.col("posted_at") >= cutoff) & F.col("posted_at_confidence").isin("HIGH", "MEDIUM") & (F.col("source") != "sample")


def from_source(source: str | None) -> Column:
    return F.lit(True) if not source or source.lower() == "all" else F.col("source") == source.lower()


def experience_at_most(years: int) -> Column:
    low, high = F.col("experience_min"), F.col("experience_max")
    intern = F.col("employment_type") == "INTERNSHIP"
    if years == 0:
        out = (low == 0) | intern | (low.isNull() & (high.isNull() | (high <= 1)))
    else:
        out = (low <= years) | (low.isNull() & (high <= years)) | (low.isNull() & high.isNull()) | intern
    return F.coalesce(out, F.lit(False))


def experience_at_least(years: int) -> Column:
    low, high = F.col("experience_min"), F.col("experience_max")
    return F.coalesce((high >= years) | (high.isNull() & (low >= years)) | (low >= years) | (low.isNull() & high.isNull()), F.lit(False))


def not_remote() -> Column:
    return F.coalesce(F.col("remote_type") != "REMOTE", F.lit(False))


def keyword(word: str, *columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(word.strip().lower())


def paid() -> Column:
    nothing = (F.col("salary_min") == 0) & (F.col("salary_max") == 0)
    return ~(F.coalesce(nothing, F.lit(False)) | is_unpaid(F.col("salary_raw")))


def not_excluded_company(company: Column, excluded: Iterable[str]) -> Column:
    """A company goes if its name holds an excluded one or is held by it; so an empty name always goes."""
    words = [e.strip().lower() for e in excluded if e.strip()]
    name = F.lower(F.trim(F.coalesce(company, F.lit(""))))
    out = F.lit(False)
    for w in words:
        out = out | name.contains(w) | F.lit(w).contains(name)
    return ~out


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def reject_reason() -> Column:
    """The first rule that the posting breaks; null for a valid one."""
    short = lambda c, n: F.length(strip(F.coalesce(F.col(c), F.lit("")))) < n
    no_url = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike("^https?://")
    return first_true(
        (short("title", 3), F.lit("title_too_short_or_empty")),
        (short("company_name", 2), F.lit("company_name_too_short_or_empty")),
        (no_url("source_url"), F.lit("invalid_source_url")),
        (no_url("application_url"), F.lit("invalid_application_url")),
        (short("description", 10), F.lit("description_too_short_or_empty")),
        (short("job_hash", 8), F.lit("invalid_or_missing_job_hash")),
    )


def all_skills(skills: Column, wanted: Iterable[str]) -> Column:
    """Each wanted skill is within some skill of the posting."""
    out = F.lit(True)
    for w in (w.strip().lower() for w in wanted):
        out = out & F.exists(skills, _holds(w))
    return out


def _holds(word: str):
    return lambda s: F.lower(s).contains(word)


def experience_tier(tier: str) -> Column:
    """Client tiers: absent bounds count as 0 and 99."""
    low, high = F.coalesce("experience_min", F.lit(0)), F.coalesce("experience_max", F.lit(99))
    return {"FRESHER": (low == 0) | (F.col("employment_type") == "INTERNSHIP"), "0_1": low <= 1, "1_2": (low <= 2) & (high >= 1), "2_3": (low <= 3) & (high >= 2), "3_PLUS": (high >= 3) & (low >= 3)}[tier]


def suggest(names: Column, part: str) -> Column:
    return F.lower(names).contains(part.strip().lower())
