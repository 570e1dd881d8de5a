"""HTML and JSON inside text columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import any_in, bound, first_true, found

# Marks of pages.
CARD_MARKS = ["individual_internship", "internship_meta", "internship_list_container", "job-card-wrapper"]
CHALLENGE_MARKS = ["cf-browser-verification", "turnstile", "verify you are human", "are you human", "robot check", "unusual traffic", "access denied"]
JSON_LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
NEXT_DATA = r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
METRIC = r"\$?\d+(?:[.,]\d+)*(?:%|\+|x|k|m)?"
DROPPED_TAGS = {"script", "style", "nav", "footer", "header", "noscript", "svg", "iframe"}
CLOSED = r"(?i)(no longer accepting applications|job (?:has )?expired|position (?:has been )?filled|applications? (?:are )?closed)"
TEXT_CAP = 10_000


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def block_state(html: Column) -> Column:
    low = F.lower(html)
    rest = F.regexp_replace(low, r"(?s)<div[^>]*id=[\"']modal_email[\"'][^>]*>.*?</div>", "")
    held = any_in(rest, ["account is put on hold", "account hold", "put on hold"]) | (rest.contains("account has been") & rest.contains("hold"))
    return first_true(
        (F.coalesce(html, F.lit("")) == "", F.lit(None)),
        (any_in(low, CARD_MARKS), F.lit(None)),
        (any_in(low, CHALLENGE_MARKS), F.lit("VERIFY_OR_CAPTCHA")),
        (held, F.lit("ACCOUNT_HOLD")),
        (rest.contains("violation of internshala") & rest.contains("rules"), F.lit("RULE_VIOLATION")),
        (any_in(rest, ["captcha", "enable javascript"]), F.lit("VERIFY_OR_CAPTCHA")),
    )


def repair_json(c: Column) -> Column:
    """The outermost object of a noisy text as JSON text, without trailing commas; '{}' if it does not parse."""
    body = F.regexp_replace(found(c, r"(?s)\{.*\}"), r",\s*([\]}])", "$1")
    return F.when(F.try_parse_json(body).isNotNull(), body).otherwise(F.lit("{}"))


def json_ld_blocks(html: Column) -> Column:
    """array<variant>: top-level lists and @graph collections are unpacked."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(JSON_LD), F.lit(1))
    parsed = F.transform(raw, lambda x: F.coalesce(F.try_parse_json(F.trim(x)), F.try_parse_json(F.regexp_replace(F.trim(x), r",\s*([\]}])", "$1"))))
    known = F.filter(parsed, lambda v: v.isNotNull())
    unpack = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))
    return F.flatten(F.transform(known, unpack))


def job_posting(html: Column) -> Column:
    """struct of the first JobPosting node; null if there is none. The page is parsed once for each row, and so is each part of the node that is read several times."""
    kind = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    nodes = F.filter(json_ld_blocks(html), lambda v: F.arrays_overlap(kind(v), F.array(*map(F.lit, ("JobPosting", "https://schema.org/JobPosting", "http://schema.org/JobPosting")))))
    return bound(F.get(nodes, 0), lambda v: F.when(v.isNotNull(), _posting(v)))


def _posting(v: Column) -> Column:
    text = lambda path: F.try_variant_get(v, path, "string")
    address = F.coalesce(*[F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(text(f"{at}.address.{part}")), F.lit("")) for part in ("addressLocality", "addressRegion", "addressCountry")]), F.lit("")) for at in ("$.jobLocation", "$.jobLocation[0]")], text("$.jobLocation.address"))
    period = lambda unit: first_true((unit.contains("MONTH"), F.lit("MONTH")), (unit.contains("HOUR"), F.lit("HOUR")), otherwise=F.lit("YEAR"))
    skills = F.coalesce(F.try_variant_get(v, "$.skills", "array<string>"), F.split(text("$.skills"), ","), F.array().cast("array<string>"))
    return F.struct(
        F.trim(F.coalesce(text("$.title"), F.lit(""))).alias("title"),
        F.trim(F.coalesce(text("$.hiringOrganization.name"), text("$.hiringOrganization"), F.lit(""))).alias("company_name"),
        strip_tags(text("$.description")).alias("description"),
        text("$.datePosted").alias("date_posted"),
        F.coalesce(text("$.employmentType[0]"), text("$.employmentType"), F.lit("FULL_TIME")).alias("employment_type"),
        F.coalesce(address, F.lit("")).alias("location"),
        F.when(F.upper(F.coalesce(text("$.jobLocationType"), F.lit(""))) == "TELECOMMUTE", "REMOTE").otherwise("ONSITE").alias("remote_type"),
        F.coalesce(F.try_variant_get(v, "$.baseSalary.value.minValue", "double"), F.try_variant_get(v, "$.baseSalary.value.value", "double"), F.try_variant_get(v, "$.baseSalary.value", "double")).alias("salary_min"),
        F.coalesce(F.try_variant_get(v, "$.baseSalary.value.maxValue", "double"), F.try_variant_get(v, "$.baseSalary.value.value", "double")).alias("salary_max"),
        F.coalesce(text("$.baseSalary.currency"), F.lit("INR")).alias("salary_currency"),
        bound(F.upper(F.coalesce(text("$.baseSalary.value.unitText"), F.lit(""))), period).alias("salary_period"),
        F.filter(F.transform(skills, lambda s: F.trim(s)), lambda s: s != "").alias("skills"),
    )


def with_fallback(**options: Column) -> Column:
    """struct(record, provenance): the first of the named records that is there, and its name."""
    where = first_true(*[(c.isNotNull(), F.lit(name)) for name, c in options.items()], otherwise=F.lit("NONE"))
    return F.struct(F.coalesce(*options.values()).alias("record"), where.alias("provenance"))


def next_data(html: Column, *paths: str) -> Column:
    """The first of the JSON paths that the page's embedded data has, as text."""
    body = found(html, NEXT_DATA, 1)
    return F.coalesce(*[F.get_json_object(body, p) for p in paths])


def metrics(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(METRIC), F.lit(0))


def keeps_metrics(before: Column, after: Column) -> Column:
    return F.forall(metrics(before), lambda m: F.contains(after, m))


class _Text(HTMLParser):
    """Visible text by line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines, self.form = 0, [], False

    def handle_starttag(self, tag, attrs):
        self.form |= tag == "form"
        if tag in DROPPED_TAGS:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.lines += [x.strip() for x in data.splitlines() if x.strip()]


def page_text(html: Column) -> Column:
    """struct(text, has_form): the visible text of a page. Nesting needs a parser, hence an Arrow UDF."""

    @F.pandas_udf("text string, has_form boolean")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page in pages:
                p = _Text()
                p.feed(page or "")
                rows.append(("\n".join(p.lines)[:TEXT_CAP], p.form))
            yield pd.DataFrame(rows, columns=["text", "has_form"])

    return parse(html)


def is_closed(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CLOSED)
