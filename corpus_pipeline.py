"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``docs``; ``run`` writes each stage's rows to the shared folder and reads them again. Operators
delete what they stage on the way, so that a stage leaves only its result behind, and runs do not meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artisieve.llm import chain_dedup, decontamination, jaccard_join, packing, toxicity
from artisieve.llm.common import staged, unused
from artisieve.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches 0.5; the model learns from all labels."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class under five-word shingles and similarity 0.8: that of the least id (then text hash;
    null ids last). Texts without words stay. Rows of one id are told apart by their texts; of rows with one id and
    one text, one stays."""
    key, rank = unused(docs.columns, "key"), unused(docs.columns, "rank")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    classes = jaccard_join.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100)
    doubles = classes.where("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    one = F.row_number().over(Window.partitionBy(key).orderBy(key))
    kept = keyed.join(doubles, key, "left_anti").withColumn(rank, one)
    return kept.where((F.col(rank) == 1) | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 or more words that an earlier document holds."""
    return chain_dedup.drop_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontamination.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned scores and passage chains are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
