"""The best postings of many candidates at once, without scoring every pair.

The share of required skills that a candidate has depends on a posting's set of skills alone. Postings of equal sets are one class,
which keeps its best ``k`` ids; an inverted index from skill to classes meets the candidates' skills in an equi-join, so a class
without a common skill is never seen, and a candidate's list is cut class by class: a class ranked below classes that hold ``k``
postings already can't add any. Candidates are a table of any size.

Defined cases: repeated skills count once; postings without skills, and candidates without any, are in no list; postings of equal share go
by id; a candidate with fewer matches than k gets those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def skill_sets(jobs: DataFrame, k: int) -> DataFrame:
    """set_id, skills, n, ids (the k smallest), size: classes of postings (job_id, skills) with equal sets of skills."""
    rows = jobs.select("job_id", F.array_sort(F.array_distinct("skills")).alias("skills")).filter(F.size("skills") > 0).withColumn("set_id", F.unhex(F.sha2(F.to_json("skills"), 256)))
    order = Window.partitionBy("set_id", "slice").orderBy("job_id")
    # Slices first, so a class of any size is cut to k ids before one task has it.
    parts = rows.withColumn("slice", F.pmod(F.xxhash64("job_id"), F.lit(64))).withColumn("at", F.row_number().over(order))
    best = parts.filter(F.col("at") <= k).groupBy("set_id").agg(F.first("skills").alias("skills"), F.slice(F.sort_array(F.collect_list("job_id")), 1, k).alias("ids"))
    sizes = rows.groupBy("set_id").agg(F.count("*").alias("size"))
    return best.join(sizes, "set_id").select("set_id", "skills", F.size("skills").alias("n"), "ids", "size")


def top_postings(jobs: DataFrame, candidates: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """profile_id, job_id, required_score, place (1 to k), and the work: pairs of classes, of candidates and of postings, that were scored.

    candidates: profile_id (one row each), skills.
    """
    classes = skill_sets(jobs, k)
    index = classes.select("set_id", "n", "size", F.explode("skills").alias("skill"))
    # Candidates of equal sets have one list, which is worked out once and given to each in the end.
    sets = candidates.select("profile_id", F.array_sort(F.array_distinct("skills")).alias("skills")).filter(F.size("skills") > 0)
    sets = sets.withColumn("own_id", F.unhex(F.sha2(F.to_json("skills"), 256)))
    own = sets.groupBy("own_id").agg(F.first("skills").alias("skills")).select("own_id", F.explode("skills").alias("skill"))
    scored = own.join(index, "skill").groupBy("own_id", "set_id").agg((F.count("*") / F.first("n") * 100).alias("score"), F.first("size").alias("size"))
    # How many postings stand in classes of a better score.
    better = Window.partitionBy("own_id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("own_id", "score")
    kept = scored.withColumn("before", F.sum("size").over(better) - F.sum("size").over(alike)).filter(F.col("before") < k)
    rows = kept.join(classes.select("set_id", "ids"), "set_id").select("own_id", "score", F.explode("ids").alias("job_id"))
    place = F.row_number().over(Window.partitionBy("own_id").orderBy(F.desc("score"), "job_id"))
    top = rows.withColumn("place", place).filter(F.col("place") <= k).select("own_id", "job_id", F.col("score").alias("required_score"), "place")
    top = sets.select("profile_id", "own_id").join(top, "own_id").drop("own_id")
    return top, scored.groupBy().agg(F.count("*").alias("scored"))
