"""The corpus pipeline: documents in, packed token pieces out, through five of the operators of sonoframe.llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from sonoframe.llm._common import cut, stored, table


def row_key() -> Column:
    """What names a row by its id and text, as an id may be null or stand for several texts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality rules reject go, each by its own verdict."""
    keyed = docs.withColumn("_key", row_key())
    kept = quality.judge(keyed.select("_key", "text"), id_col="_key").where("kept").select("_key")
    return keyed.join(kept.distinct(), "_key", "left_semi").drop("_key")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id (of its texts under that id, that with the least hash)
    stays, once if it is repeated; a null id counts as the greatest. Rows of one id with unlike texts are unlike rows."""
    keyed = docs.withColumn("_key", row_key())
    found = ngram_join.near_duplicates(keyed.select("_key", "text"), id_col="_key").select("_key", "class_id").distinct()
    ranked = found.join(keyed.select("_key", "doc_id"), "_key").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("least"))
    return keyed.join(ranked.select("least._key"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that repeat across the corpus go; a character that is cut goes whole."""
    removed = suffix_dedup.remove_repeats(docs, whole_characters=True)
    out = removed.select("doc_id", F.col("kept").cast("string").alias("text"), "row.*").withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds 0.8 or more of a benchmark item's shingles go."""
    keyed = docs.withColumn("_key", row_key())
    found = decontaminate.contained(keyed.select("_key", "text"), table(spark, sf_dir, "benchmark"), id_col="_key")
    return keyed.join(cut(found.select("_key").distinct()), "_key", "left_anti").drop("_key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the sequences that training reads."""
    return packing.pack_digest(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Expectation-maximisation, Bayesian pruning and packing have no SQL; tests/llm/test_pipeline.py has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written, so that the next doesn't work it out again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
