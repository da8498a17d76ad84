"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; run() writes each result as
Parquet in the shared folder and reads it back, so a lost executor never repeats a stage. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from quirelight.llm.common import durable, table
from quirelight.llm.queries import tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group (key, group) of rows the one with the smallest doc_id stays, null last; ids may repeat or be null.

    Rows are known by a hash of id and text; rows that repeat both are one. Spark broadcasts what goes only while it is small.
    """
    clash = "_key"
    while clash in docs.columns:
        clash += "_"
    keyed = docs.withColumn(clash, row_key())
    groups = durable(groups, "groups")
    several = durable(groups.groupBy("group").agg(F.count("*").alias("rows")).filter("rows > 1").select("group"), "several")
    members = durable(groups.join(several, "group").groupBy("key", "group").agg(F.count("*").alias("rows")), "members")
    named = durable(docs.select(row_key().alias("key"), "doc_id").join(members.select("key", "group"), "key"), "named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = durable(named.groupBy("group").agg(F.min(order)["key"].alias("best")), "best")
    dropped = durable(named.join(best, "group").filter("key <> best").select(F.col("key").alias(clash)).distinct(), "dropped")
    kept = keyed.join(dropped, clash, "left_anti")
    repeated = members.filter("rows > 1").select(F.col("key").alias(clash))
    once = kept.join(repeated, clash, "left_semi").dropDuplicates([clash])
    return kept.join(repeated, clash, "left_anti").unionByName(once).select(docs.columns)


def _by_key(docs: DataFrame) -> DataFrame:
    """The rows' keys in place of their ids: no key is null, and none stands for two texts."""
    return docs.select(row_key().alias("doc_id"), "text")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    found = exact_dedup.exact_dedup(_by_key(docs)).filter("group_size > 1")
    return _one_of_each(docs, found.select(F.col("doc_id").alias("key"), F.col("keep_id").alias("group")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays."""
    found = jaccard_join.near_duplicates(_by_key(docs)).filter("n_shingles > 0")
    return _one_of_each(docs, found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are generalised and the terms that disclose it removed; n_chars follows the text."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor the learned model; tests hold the deduplicating stages against expected rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
