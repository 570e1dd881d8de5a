"""A corpus pipeline over ``documents``: language ID, exact dedup, near dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread before the next one.
All but the last keep the columns of docs. Rows move by id between an operator's decision and the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import exact, jaccard, langid, mixing, packing
from postmill.llm.common import materialise
from postmill.llm.python_queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null texts and texts without a letter. Fits on the labelled rows of docs."""
    return langid.predict(docs, langid.fit(docs), with_spans=False).filter("letters > 0").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five words the smallest doc_id stays. Rows go by doc_id and text, so another text with the same id is not touched."""
    groups = jaccard.near_groups(docs, k=5, percent=80)
    lost = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("own"))
    return rows.join(materialise(lost, "near-lost"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("key")), "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a repeated document is packed as often as it occurs."""
    packed = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID, near-duplicate components and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
