"""Fingerprints, keys, ids and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import any_in, first_true, found, strip

# Fixed values.
AGGREGATORS = ["naukri.com", "internshala.com", "linkedin.com", "indeed.com", "instahyre.com", "wellfound.com", "cutshort.io"]
CAREERS = ["careers", "jobs", "apply", "greenhouse.io", "lever.co", "workday.com", "ashbyhq.com"]


def clean_part(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("generic")).otherwise(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))


def fingerprint(company: Column, title: Column, location: Column, employment_type: Column, source_job_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", *map(clean_part, (company, title, location, employment_type, source_job_id))), 256)


def is_direct_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return ~any_in(low, AGGREGATORS) & any_in(low, CAREERS)


def external_id(url: Column) -> Column:
    """A posting's number in a URN, at the end of a URL, or anywhere in it."""
    return F.coalesce(found(url, r"urn:li:jobPosting:(\d+)", 1), found(url, r"(\d{6,16})/?(?:\?.*)?$", 1), found(url, r"(\d{6,16})", 1))


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(url), r"[?#].*$", ""), "/+$", "")


def mask_secret(c: Column) -> Column:
    return first_true((c.isNull() | (c == ""), F.lit("")), (F.length(c) <= 7, F.lit("***")), otherwise=F.concat(F.substring(c, 1, 3), F.lit("..."), F.substring(c, -4, 4)))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16)


def version(*parts: Column) -> Column:
    """Equal exactly when the parts are: lists are compared without order and case by the caller's sorted_low."""
    return cache_key(*[p.alias(f"p{i}") for i, p in enumerate(parts)])


def sorted_low(items: Column) -> Column:
    return F.array_sort(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))


def clean_text(c: Column) -> Column:
    """Trimmed; blank and the words for nothing become null."""
    t = strip(c)
    return F.when((t == "") | F.lower(t).isin("nan", "none", "null"), F.lit(None)).otherwise(t)


def clean_number(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
