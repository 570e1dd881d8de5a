"""Counts beside the feed: cross-filtered facets, tiers, funnels, skill gaps, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_intern() -> Column:
    return F.coalesce((F.col("employment_type") == "INTERNSHIP") | F.lower("title").contains("intern") | F.lower("experience_raw").contains("intern"), F.lower(F.coalesce("title", F.lit(""))).contains("intern"))


def tiers() -> dict[str, Column]:
    """Overlapping tiers; a posting may be in several."""
    low, high = F.col("experience_min"), F.col("experience_max")
    text = F.coalesce("experience_raw", F.lit(""))
    least, most = F.coalesce(low, F.lit(0)), F.coalesce(high, low, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    has = lambda *w: text.contains(w[0]) | text.contains(w[1])
    return {
        "fresher": yes(low == 0) | is_intern() | F.lower(text).contains("fresher") | (low.isNull() & (high.isNull() | yes(high <= 1))),
        "y0_1": yes(low <= 1) | yes(high <= 1) | is_intern(),
        "y1_2": ((least <= 2) & (most >= 1)) | has("1-2", "0-2"),
        "y2_3": ((least <= 3) & (most >= 2)) | has("2-3", "1-3"),
        "y3_plus": (most >= 3) | (least >= 3),
    }


def flags(rows: DataFrame, loc: Column, kind: Column, exp: Column) -> DataFrame:
    """Each facet filters by the others but not by itself: three flags per row, then one pass for every count."""
    return rows.withColumns({"loc_ok": F.coalesce(loc, F.lit(False)), "type_ok": F.coalesce(kind, F.lit(False)), "exp_ok": F.coalesce(exp, F.lit(False)), "intern": is_intern()})


def type_counts(f: DataFrame) -> DataFrame:
    return f.agg(
        F.count_if(F.col("loc_ok") & F.col("type_ok") & F.col("exp_ok")).alias("n_all"),
        F.count_if(F.col("loc_ok") & F.col("exp_ok") & ~F.col("intern")).alias("n_jobs"),
        F.count_if(F.col("loc_ok") & F.col("exp_ok") & F.col("intern")).alias("n_internships"),
    )


def source_counts(f: DataFrame) -> DataFrame:
    return f.filter("loc_ok AND type_ok AND exp_ok").groupBy(F.lower("source").alias("source")).agg(F.count("*").alias("n"))


def tier_counts(f: DataFrame) -> DataFrame:
    return f.filter("loc_ok AND type_ok").agg(*[F.count_if(test).alias(name) for name, test in tiers().items()])


def location_counts(rows: DataFrame, names: Column) -> DataFrame:
    """One count per place of a posting, whatever filters are set."""
    return rows.select(F.explode(F.array_distinct(names)).alias("place")).filter("place <> 'Unknown'").groupBy("place").agg(F.count("*").alias("n"))


def status_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """One row, a column per status, zero where none."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses])


def funnel(scores: Column, *levels: float) -> list[Column]:
    return [F.count_if(scores >= level).alias(f"at_least_{level:g}") for level in levels]


def skill_gap(rows: DataFrame, candidate: list[str], top: int = 6) -> DataFrame:
    """rows: job_id, skills. Skills that the candidate lacks, by how many postings want them, with their share of all. rows are read once."""
    lacking = F.array_except("skills", F.array(*map(F.lit, candidate))) if candidate else F.col("skills")
    # A null stands for the posting itself, so that one aggregation also counts the postings.
    counts = rows.select(F.explode(F.concat(lacking, F.array(F.lit(None).cast("string")))).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.col("skill").isNotNull(), F.desc("n"), "skill").limit(top + 1)
    # So few rows meet in one window.
    total = F.max(F.when(F.col("skill").isNull(), F.col("n"))).over(Window.partitionBy())
    return best.withColumn("total", total).filter("skill IS NOT NULL").select("skill", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


def rollup(rows: DataFrame) -> DataFrame:
    """Per-source outcome: sums and a status by which of the attempts succeeded. rows: source, ok, fetched."""
    status = F.when(F.bool_and("ok"), "success").when(F.bool_or("ok"), "partial_success").otherwise("failed")
    return rows.groupBy("source").agg(F.count("*").alias("attempts"), F.sum("fetched").alias("fetched"), status.alias("status"))


def last_observations(rows: DataFrame, key: str, at: list[str], value: str, n: int = 100) -> DataFrame:
    """Count, mean, least and most of the last n observations of each key. Ranks are limited before the sort is whole."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in at])
    recent = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return recent.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def precision_recall(predicted: Column, truth: Column) -> Column:
    """struct(precision, recall, f1, overlap) of two token lists, compared by their letters and digits."""
    norm = lambda items: F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")), lambda x: x != ""))
    p, t = norm(predicted), norm(truth)
    common = F.size(F.array_intersect(p, t))
    both_empty, none, no_truth = (F.size(p) == 0) & (F.size(t) == 0), F.size(p) == 0, F.size(t) == 0
    precision = F.when(both_empty, 1.0).when(none | no_truth, 0.0).otherwise(common / F.size(p))
    recall = F.when(both_empty, 1.0).when(none, 0.0).when(no_truth, 1.0).otherwise(common / F.size(t))
    f1 = F.when(both_empty, 1.0).when((precision + recall == 0) | no_truth, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return F.struct(F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), common.alias("overlap"))


def profile_record(predicted: Column, truth: Column) -> Column:
    """struct of what an extracted profile gets right. Both: struct(skills, experience_level, experience_years)."""
    got = precision_recall(predicted["skills"], truth["skills"])
    level = lambda x: F.upper(F.coalesce(x["experience_level"], F.lit("")))
    years = lambda x: F.coalesce(x["experience_years"], F.lit(0))
    return F.struct(
        got["precision"].alias("skill_precision"), got["recall"].alias("skill_recall"), got["f1"].alias("skill_f1"), (level(predicted) == level(truth)).cast("double").alias("experience_level_match"),
        F.abs(years(predicted) - years(truth)).alias("experience_years_diff"), F.size(predicted["skills"]).alias("predicted_count"), F.size(truth["skills"]).alias("truth_count"),
    )


def enrichment_record(predicted: Column, truth: Column) -> Column:
    """struct of what an enriched posting gets right. Both: struct(required_skills, preferred_skills, tech_stack, seniority)."""
    required, preferred, stack = (precision_recall(predicted[c], truth[c]) for c in ("required_skills", "preferred_skills", "tech_stack"))
    level = lambda x: F.upper(F.coalesce(x["seniority"], F.lit("")))
    return F.struct(
        required["f1"].alias("required_skills_f1"), required["precision"].alias("required_skills_precision"), required["recall"].alias("required_skills_recall"), preferred["f1"].alias("preferred_skills_f1"),
        stack["f1"].alias("tech_stack_f1"), (level(predicted) == level(truth)).cast("double").alias("seniority_match"),
    )


def evaluation_report(cases: DataFrame) -> DataFrame:
    """One row over cases (category, schema_valid, latency_ms, f1): counts, rates and means; zero where there is none."""
    mean = lambda c, places: F.round(F.coalesce(F.avg(c), F.lit(0.0)), places)
    own = lambda kind: F.when(F.col("category") == kind, F.col("f1"))
    return cases.agg(
        F.count("*").alias("total_fixtures"), mean(F.col("schema_valid").cast("double"), 4).alias("schema_valid_rate"), mean(F.col("latency_ms"), 2).alias("avg_latency_ms"),
        mean(own("resume"), 4).alias("avg_resume_skill_f1"), mean(own("job"), 4).alias("avg_job_required_skill_f1"),
    )
