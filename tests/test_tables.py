"""What is broadcast goes by rows, not by compressed files."""

from pyspark.sql import functions as F

from postmill.operators import tables

FACTOR = "spark.sql.sources.fileCompressionFactor"


def test_a_table_that_is_small_only_as_a_file_is_not_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset(FACTOR)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
        rows = tables.cut_lineage(spark.range(200_000).select("id", F.lit(1).alias("x")))
        plan = rows.join(rows.withColumnRenamed("x", "y"), "id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
        spark.conf.set(FACTOR, "3.0")
        tables.expect_inflation(spark)
        assert spark.conf.get(FACTOR) == "3.0"
    finally:
        spark.conf.unset(FACTOR)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
