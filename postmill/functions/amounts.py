"""Salaries and experience requirements in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import first_true, found, strip

# Words of unpaid work.
UNPAID = r"\b(unpaid|no\s+stipend|expenses\s+only|volunteer|zero\s+stipend|performance\s+based|incentives?\s+only)\b"
# Salary patterns in order, with the factor to a year's rupees.
SALARIES = [
    (r"(\d+(?:\.\d+)?)\s*(?:-|to)?\s*(\d+(?:\.\d+)?)?\s*(?:cr|crore)", 1e7),
    (r"(\d+(?:\.\d+)?)\s*(?:-|to)?\s*(\d+(?:\.\d+)?)?\s*(?:lpa|lakh|lac)", 1e5),
    (r"(\d+)\s*(?:-|to)?\s*(\d+)?\s*(?:/month|per month|pm)", 12.0),
    (r"(?:₹|rs\.?|inr)?\s*(\d{5,8})\s*(?:-|to)?\s*(\d{5,8})?", 1.0),
]
# Patterns of years of experience.
RANGE = r"(\d+)\s*(?:-|to)\s*(\d+)\s*(?:years?|yrs?|yr)\b"
PLUS = r"(\d+)\s*\+\s*(?:years?|yrs?|yr)\b"
SINGLE = r"(?:at\s+least|min(?:imum)?\s*)?(\d+)\s*(?:years?|yrs?|yr)\b"
FRESH = r"\b(fresher|freshers|entry\s+level|no\s+experience|0\s*(?:-|to)\s*0\s*(?:yrs?|years?)|intern|internship|graduate)\b"
SHIFT = r"\b\d+\s*(?:days?|weeks?|hours?|hrs?|months?)\s*(?:a|per|/)\s*(?:week|month|day)\b"
TENURE = r"\b(?:years?|yrs?|yr|fresher|intern|experience|exp)\b"
NAMED_RANGE = r"(?:experience|exp)[:\s]+(\d+)\s*(?:-|to)\s*(\d+)\b(?!\s*(?:days?|weeks?|hours?|months?))"
NAMED = r"(?:experience|exp)[:\s]+(\d+)\b(?!\s*(?:days?|weeks?|hours?|months?))"
MENTION = r"\b(?:years?|yrs?|yr|experience|exp|fresher|intern|entry\s*level)\b"
AT_LEAST = r"\b(?:at\s+least|min(?:imum)?|minimum\s+of)\s*\d"


def is_unpaid(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).rlike(UNPAID), F.lit(False))


def parse_salary(raw: Column) -> Column:
    """struct(salary_min, salary_max, currency, period, is_unpaid): rupees a year."""
    t = F.replace(F.lower(strip(raw)), F.lit(","), F.lit(""))
    unpaid = is_unpaid(t)

    def bounds(low: Column, high: Column) -> Column:
        return F.struct(F.least(low, high).alias("salary_min"), F.greatest(low, high).alias("salary_max"))

    cases = [(unpaid, bounds(F.lit(0.0), F.lit(0.0)))]
    for pattern, factor in SALARIES:
        first = found(t, pattern, 1).cast("double") * factor
        cases.append((first.isNotNull(), bounds(first, F.coalesce(found(t, pattern, 2).cast("double") * factor, first))))
    none = F.struct(F.lit(None).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"))
    pair = first_true(*cases, otherwise=none)
    return F.struct(pair["salary_min"].alias("salary_min"), pair["salary_max"].alias("salary_max"), F.lit("INR").alias("currency"), F.lit("YEAR").alias("period"), unpaid.alias("is_unpaid"))


def parse_experience(text: Column) -> Column:
    """struct(exp_min, exp_max, exp_text, confidence)."""
    cleaned = strip(text)
    t = F.lower(cleaned)

    def out(low, high, snippet: Column, confidence: str) -> Column:
        as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
        return F.struct(as_int(low).alias("exp_min"), as_int(high).alias("exp_max"), snippet.cast("string").alias("exp_text"), F.lit(confidence).alias("confidence"))

    short = F.length(cleaned) <= 100
    snippet = lambda pattern: F.when(short, cleaned).otherwise(found(t, pattern))
    number = lambda pattern, g=1: found(t, pattern, g).cast("int")
    none = F.lit(None)
    return first_true(
        (F.coalesce(cleaned, F.lit("")) == "", out(none, none, none, "LOW")),
        (t.rlike(SHIFT) & ~t.rlike(TENURE), out(none, none, F.when(short, cleaned).otherwise(strip(F.substring(cleaned, 1, 100))), "LOW")),
        (t.rlike(FRESH) & ~t.rlike(RANGE), out(0, 0, snippet(FRESH), "HIGH")),
        (t.rlike(RANGE), out(number(RANGE, 1), number(RANGE, 2), snippet(RANGE), "HIGH")),
        (t.rlike(PLUS), out(number(PLUS), none, snippet(PLUS), "HIGH")),
        (t.rlike(SINGLE) & t.rlike(AT_LEAST), out(number(SINGLE), none, snippet(SINGLE), "HIGH")),
        (t.rlike(SINGLE), out(number(SINGLE), number(SINGLE), snippet(SINGLE), "HIGH")),
        (t.rlike(NAMED_RANGE), out(number(NAMED_RANGE, 1), number(NAMED_RANGE, 2), snippet(NAMED_RANGE), "HIGH")),
        (t.rlike(NAMED), out(number(NAMED), number(NAMED), snippet(NAMED), "HIGH")),
        (t.rlike(MENTION), out(none, none, F.when(short, cleaned), "LOW")),
        otherwise=out(none, none, none, "LOW"),
    )


def experience_display(employment_type: Column, text: Column, low: Column, high: Column) -> Column:
    return first_true(
        (employment_type == "INTERNSHIP", F.lit("Internship")),
        (F.coalesce(text, F.lit("")) != "", text),
        (low.isNotNull() & high.isNotNull(), F.format_string("%d-%d years", low, high)),
        (low.isNotNull(), F.format_string("%d+ years", low)),
        otherwise=F.lit("Not specified"),
    )
