"""A corpus pipeline of four operators: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. doc_id is the key of documents; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import neardup, packing, quality, secrets
from trendloom.llm.common import keep, text_column
from trendloom.llm.queries import table, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row is judged by itself, also without an id."""
    return quality.judge_quality(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a Jaccard similarity of 0.8 or more.

    Rows are judged by their own text, also where they share a doc_id; the smallest (doc_id, digest of the text) of a group
    stays, of rows equal in both the one whose JSON has the smallest hash. Documents without an id stay.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_column(docs, "text").cast("binary")).alias("key"), text_column(docs, "text").alias("text"), F.struct(*docs.columns).alias("row"))
    found = keep(neardup.repeats(keyed.select("doc_id", "key", "text")), "found")
    dropped = found.where("not kept").select(F.col("doc_id").alias("dropped_id"), F.col("key").alias("dropped_key"))
    kept = keyed.drop("text").join(dropped.hint("merge"), (F.col("doc_id") == F.col("dropped_id")) & (F.col("key") == F.col("dropped_key")), "left_anti")
    if not found.where("kept and n > 1").isEmpty():
        one = kept.where("doc_id is not null").groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = one.select("row").union(kept.where("doc_id is null").select("row"))
    return kept.select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark and n_chars counted anew (if the table has it) where there were any."""
    spans = "spans"
    while spans in map(str.lower, docs.columns):
        spans += "_"
    found = secrets.find_secrets(docs, secrets.train(docs, table(spark, sf_dir, "labels")), spans_col=spans)
    hit = F.size(spans) > 0
    masked = found.withColumn("text", F.when(hit, secrets.redacted(text_column(found, "text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("secrets", mask_secrets), ("packing", pack_sequences)]

#: Models, hashes and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
