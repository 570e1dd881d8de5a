"""Candidates: profile merging, contacts, skill plans, eligibility, approvals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import first_true, ordered_distinct
from .titles import is_senior_title


def merge_field(overrides: Column, field: str, stored: Column, found: Column) -> Column:
    """A field that was set by hand stays; otherwise what was found replaces it, if anything was."""
    return F.when(F.array_contains(overrides, field), stored).otherwise(F.coalesce(found, stored))


def contact(*options: Column) -> Column:
    """The first that is neither blank nor a placeholder."""
    bad = ["", "n/a", "none", "unknown", "your name", "candidate"]
    return F.coalesce(*[F.when(~F.lower(F.trim(c)).isin(bad), F.trim(c)) for c in options])


def skill_plan(candidate: Column, wanted: Column, first: int = 3) -> Column:
    """struct(matched, missing, extra, plan): sorted sets and four days for each of the first missing."""
    missing = F.array_sort(F.array_except(wanted, candidate))
    plan = F.transform(F.slice(missing, 1, first), lambda s, i: F.format_string("Days %d-%d: %s", i * 4 + 1, i * 4 + 4, s))
    return F.struct(F.array_sort(F.array_intersect(candidate, wanted)).alias("matched"), missing.alias("missing"), F.array_sort(F.array_except(candidate, wanted)).alias("extra"), plan.alias("plan"))


def exclusion_reasons(ceiling: int, unpaid: Column, outside: Column, role_out: Column, company_out: Column) -> Column:
    """Reasons that speak against a posting, for information only."""
    low, high = F.col("experience_min"), F.col("experience_max")
    too_senior = (F.col("employment_type") != "INTERNSHIP") & (F.coalesce(low > ceiling, F.lit(False)) | (F.lit(ceiling <= 2) & is_senior_title(F.col("title"))))
    span = first_true((low.isNotNull() & high.isNotNull(), F.format_string("%d-%dy", low, high)), (low.isNotNull(), F.format_string("%d+y", low)), otherwise=F.lit("unspecified"))
    said = lambda test, text: F.when(F.coalesce(test, F.lit(False)), text)
    return F.array_compact(F.array(
        said(too_senior, F.concat(F.lit("Experience required ("), span, F.lit(f") exceeds preference ceiling ({ceiling}y)"))),
        said(unpaid, F.lit("Unpaid position (preference requires paid positions)")),
        said(outside, F.concat(F.lit("Location '"), F.coalesce("location", F.lit("None")), F.lit("' outside preferred locations"))),
        said(role_out, F.lit("Role in candidate's excluded roles")),
        said(company_out, F.lit("Company in candidate's excluded companies")),
    ))


def preference_problem() -> Column:
    """The first rule that a preference row breaks."""
    return first_true(
        ((F.col("match_threshold") < 0) | (F.col("match_threshold") > 100), F.lit("match_threshold")),
        (~F.col("freshness_hours").isin(1, 4, 8, 12, 16, 24), F.lit("freshness_hours")),
        (F.col("experience_max_years") < 0, F.lit("experience_max_years")),
        (~F.upper(F.coalesce("role_type", F.lit("ALL"))).isin("ALL", "JOBS", "INTERNSHIPS"), F.lit("role_type")),
    )


def approval_step(status: Column, decision: Column, expires: Column, now: Column) -> Column:
    """Pending approvals expire by the clock or take a decision; others stay as they are."""
    return first_true((status != "PENDING", status), (expires < now, F.lit("EXPIRED")), (decision.isin("APPROVED", "REJECTED"), decision), otherwise=F.lit("PENDING"))


def setup_flags(profile: Column, n_resumes: Column, sources_enabled: Column, provider: Column) -> Column:
    """struct(has_profile, has_resume, has_sources, has_ai_provider). profile: struct(target_roles, skills, experience_years) or null."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    has = profile.isNotNull() & (some(profile["target_roles"]) | some(profile["skills"]) | F.coalesce(profile["experience_years"] > 0, F.lit(False)))
    return F.struct(has.alias("has_profile"), (F.coalesce(n_resumes, F.lit(0)) > 0).alias("has_resume"), F.coalesce(sources_enabled, F.lit(True)).alias("has_sources"), (F.coalesce(provider, F.lit("")) != "").alias("has_ai_provider"))


def research_notes(raw: Column) -> Column:
    """struct(company_summary, products, tech_stack, culture_values) of a JSON text: the first name that has a value, cut to size."""
    got = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in names])

    def items(most: int, *names: str) -> Column:
        text = got(*names)
        listed = F.from_json(text, "array<string>")
        return F.when(text.startswith("["), F.when(F.size(listed) > 0, F.slice(listed, 1, most))).when(text.isNotNull(), F.array(F.substring(text, 1, 150)))

    summary = F.coalesce(F.substring(got("company_summary", "description", "about"), 1, 350), F.substring(got("text"), 1, 300))
    return F.struct(summary.alias("company_summary"), items(4, "products", "core_products").alias("products"), items(6, "tech_stack", "technologies").alias("tech_stack"), items(3, "culture", "values").alias("culture_values"))


def fallback_profile(skills: Column) -> Column:
    """The profile that stands where extraction failed: known skills of the text, ten at most."""
    return F.struct(F.lit("Candidate").alias("candidate_name"), F.lit("FRESHER").alias("experience_level"), F.lit(0).alias("experience_years"), F.slice(skills, 1, 10).alias("skills"), F.lit("Profile parsed via fallback.").alias("summary"))


def fallback_enrichment(title: Column, category: Column, low: Column, required: Column, preferred: Column) -> Column:
    """The enrichment that stands where extraction failed."""
    summary = F.when(F.size(required) > 0, F.array(F.concat(F.lit("Experience with "), F.array_join(F.slice(required, 1, 4), ", ")))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        title.alias("standardized_title"), category.alias("role_category"), F.when(F.coalesce(low, F.lit(0)) <= 1, "ENTRY_LEVEL").otherwise("MID").alias("seniority"), required.alias("required_skills"), preferred.alias("preferred_skills"),
        summary.alias("requirements_summary"), F.slice(required, 1, 6).alias("tech_stack"),
    )
