"""Posting times: relative phrases, ages, freshness. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import any_in, first_true, found, strip

# Fixed values.
STALE_UNITS = r"\b(?:\d+\s*)?(?:months?|mo|years?|yrs?|weeks?|wks?|duration|starts?\s+in|starts?\s+within)\b"
NOW_WORDS = ["just now", "just posted", "few seconds ago", "seconds ago"]
TODAY_WORDS = ["today", "active today", "new", "posted recently", "recently", "posted today"]
YESTERDAY_WORDS = ["yesterday", "1 day ago", "1d ago", "active 1 day ago"]
MINUTES = r"\b(\d+)\s*(?:minutes?|mins?|m)\s*(?:ago)?\b"
HOURS = r"\b(\d+)\s*(?:hours?|hrs?|h)\s*(?:ago)?\b"
DAYS = r"\b(\d+)\s*(?:days?|d)\s*(?:ago)?\b"
DATE = r"^(\d{4}-\d{2}-\d{2})$"
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
WINDOWS = [1, 4, 8, 12, 16, 24]


def ago(now: Column, hours: Column | float) -> Column:
    return F.timestamp_seconds(F.unix_micros(now.cast("timestamp")) / 1e6 - (hours if isinstance(hours, Column) else F.lit(float(hours))) * 3600)


def parse_recency(text: Column, now: Column, strict: bool = False) -> Column:
    """struct(ts, confidence). strict wants the words of the today and yesterday rules to stand alone."""
    t = F.lower(strip(text))
    has = (lambda words: t.rlike(r"\b(?:" + "|".join(words) + r")\b")) if strict else (lambda words: any_in(t, words))

    def out(ts: Column, confidence: Column | str) -> Column:
        return F.struct(ts.cast("timestamp").alias("ts"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    number = lambda p: found(t, p, 1).cast("double")
    day = F.try_to_date(found(strip(text), DATE, 1)) if hasattr(F, "try_to_date") else F.to_date(found(strip(text), DATE, 1))
    behind = F.datediff(now.cast("date"), day)
    none = F.lit(None)
    return first_true(
        (F.coalesce(t, F.lit("")) == "", out(none, "LOW")),
        (t.rlike(STALE_UNITS), out(none, "LOW")),
        (has(NOW_WORDS), out(now, "HIGH")),
        (t.contains("half an hour ago"), out(ago(now, 0.5), "HIGH")),
        (t.rlike(r"\b(?:a\s+)?few\s+hours?\s+ago\b"), out(ago(now, 3), "HIGH")),
        (t.rlike(r"\b(?:an?|1)\s+hour\s+ago\b"), out(ago(now, 1), "HIGH")),
        (has(TODAY_WORDS), out(ago(now, 0.5), "HIGH")),
        (has(YESTERDAY_WORDS), out(ago(now, 12), "HIGH")),
        (t.rlike(MINUTES), out(ago(now, number(MINUTES) / 60), "HIGH")),
        (t.rlike(HOURS), out(ago(now, number(HOURS)), F.when(number(HOURS) <= 24, "HIGH").otherwise("LOW"))),
        (t.rlike(DAYS) & (number(DAYS) == 1), out(ago(now, 12), "HIGH")),
        (t.rlike(DAYS), out(ago(now, number(DAYS) * 24), "LOW")),
        (day.isNotNull() & (behind == 0), out(ago(now, 12), "MEDIUM")),
        (day.isNotNull() & (behind == 1), out(ago(now, 20), "MEDIUM")),
        (day.isNotNull(), out(ago(now, F.greatest(F.lit(2), behind) * 24.0), "LOW")),
        (strip(text).rlike(ISO), out(F.try_to_timestamp(strip(text)), "HIGH")),
        otherwise=out(none, "LOW"),
    )


def age_hours(posted: Column, now: Column) -> Column:
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(posted.cast("timestamp"))) / 1e6
    return F.greatest(F.lit(0.0), F.round(seconds / 3600, 2))


def freshness(posted: Column, confidence: Column, hours: float, now: Column) -> Column:
    """struct(is_fresh, reason, age)."""
    age = age_hours(posted, now)
    reason = first_true(
        (posted.isNull(), F.lit("missing_posted_at")),
        (~F.coalesce(confidence, F.lit("")).isin("HIGH", "MEDIUM"), F.concat(F.lit("low_confidence_"), F.coalesce(confidence, F.lit("None")))),
        (age > hours, F.concat(F.lit("stale_age_"), F.format_string("%.2f", age), F.lit(f"h_exceeds_{float(hours)}h"))),
        otherwise=F.lit("fresh"),
    )
    return F.struct((reason == "fresh").alias("is_fresh"), reason.alias("reason"), age.alias("age"))


def freshness_class(posted: Column, confidence: Column, hours: float, now: Column) -> Column:
    return first_true((posted.isNull() | (confidence == "LOW"), F.lit("UNCERTAIN")), (freshness(posted, confidence, hours, now)["is_fresh"], F.lit("FRESH")), otherwise=F.lit("STALE"))


def clamp_window(hours: Column) -> Column:
    """The nearest allowed window, the smaller of two as near."""
    options = F.array(*[F.struct(F.abs(hours - w).alias("away"), F.lit(w).alias("hours")) for w in WINDOWS])
    return F.array_min(options)["hours"]


def greeting(now: Column) -> Column:
    h = F.hour(now)
    return first_true((h < 12, F.lit("Good morning")), (h < 17, F.lit("Good afternoon")), otherwise=F.lit("Good evening"))


# What marks a text as relative to the time of reading.
RELATIVE = ["hour", "hr", "h", "min", "sec", "just now", "today", "yesterday", "day ago", "d ago", "recently"]


def chosen_recency(text: Column, attribute: Column, now: Column) -> Column:
    """struct(ts, confidence): a relative text, else the page's date attribute, else what the text says. now is when the page was read."""
    said, dated = parse_recency(text, now), parse_recency(attribute, now)
    relative = F.coalesce(any_in(F.lower(strip(text)), RELATIVE), F.lit(False))
    return first_true((relative & said["ts"].isNotNull(), said), (dated["ts"].isNotNull(), dated), (~relative & said["ts"].isNotNull(), said), otherwise=F.struct(F.lit(None).cast("timestamp").alias("ts"), F.lit("LOW").alias("confidence")))


def epoch_recency(millis: Column, text: Column, now: Column) -> Column:
    """struct(ts, confidence): a positive epoch in milliseconds first, else the text."""
    number = F.when(F.btrim(millis).rlike(r"^\d+(\.\d*)?$"), F.btrim(millis).cast("double"))
    return F.when(number > 0, F.struct(F.timestamp_micros((number * 1000).cast("long")).alias("ts"), F.lit("HIGH").alias("confidence"))).otherwise(parse_recency(text, now))
