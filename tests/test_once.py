"""Expressions that read their input once, however many rules look at it."""

import pytest
from pyspark.sql import functions as F

from postmill.functions import markup, places


def times_read(spark, make):
    """How often the expression names its input."""
    rows = spark.createDataFrame([("x",)], "given string")
    plan = rows.select(make(F.col("given")).alias("out"))._jdf.queryExecution().analyzed()
    return plan.expressions().apply(0).collectLeaves().mkString(" ").count("given#")


@pytest.mark.parametrize("make", [places.resolve, places.entities, places.normalize_location])
def test_places_read_the_text_once(spark, make):
    assert times_read(spark, make) == 1


def test_places_by_the_same_rules(spark):
    cases = {
        "KA": "Karnataka", "blr": "Bengaluru", "NCR": "Delhi NCR", "tamil nadu": "Tamil Nadu", "Greater Noida West": "Greater Noida", "Kerala, IN": "Kerala", "Salem, Tamil Nadu": "Salem", "India": "India",
        "remote, anywhere": "Remote / Anywhere", "wfh india": "Remote (India)", "new york": "New York", " ; ": "Unknown", None: "Unknown", "Pune/pune | PNQ": "Pune",
    }
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, c string")
    assert [r[0] for r in rows.orderBy("i").select(places.normalize_location(F.col("c"))).collect()] == list(cases.values())


def test_a_job_posting_parses_the_page_once(spark):
    assert times_read(spark, markup.job_posting) == 1
