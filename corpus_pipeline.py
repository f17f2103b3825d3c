"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from factloom.scratch import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that fail the base rules or score below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = quality.judged(docs, labels.where("quality = 1")).where("not kept").select("doc_id", "key").alias("v")
    rows = docs.withColumn("key", F.xxhash64("text")).alias("d")
    return rows.join(verdict, F.expr("d.doc_id <=> v.doc_id and d.key = v.key"), "left_anti").select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keep the one with the largest doc_id; of its repeated rows the least."""
    judged = staged(exact_dedup.exact_duplicates(docs).select("doc_id", "kept", "text_sha256"), "pipe-exact")
    rows = docs.withColumn("sha", F.sha2(exact_dedup.normalised(), 256)).alias("d")
    same = F.expr("d.doc_id <=> g.doc_id and d.sha = g.text_sha256")
    left = rows.join(judged.where("not kept").alias("g"), same, "left_anti")
    repeated = staged(judged.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1"), "pipe-repeated")
    if repeated.isEmpty():
        return left.select(*COLUMNS)
    once = left.alias("d").join(repeated.alias("g"), same, "left_anti").select(*COLUMNS)
    least = left.alias("d").join(repeated.alias("g"), same, "left_semi").groupBy("doc_id", "sha").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.unionByName(least.select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents similar on five-word shingles, keep one: the one of the least doc_id, then text hash.

    Different texts under one doc_id are documents of their own; rows without a doc_id stay.
    """
    found = near_dedup.near_duplicates(docs, k=5, num=80, den=100)
    gone = found.where("not first and doc_id is not null").select("doc_id", "text_key").distinct().alias("g")
    rows = docs.withColumn("key", F.xxhash64("text")).alias("d")
    return rows.join(gone, F.expr("d.doc_id = g.doc_id and d.key = g.text_key"), "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it, in whole documents; 0 times leaves it out.

    A document taken in part is rounded by the hash of its id (of its text where
    it has none), so a source's words stay near its target.  Rows of one doc_id,
    text and source share one decision, the mean of what the mix takes of them.
    """
    taken = mixing.mix(docs).groupBy("doc_id", "key", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("taken > 0")
    share = F.pmod(F.xxhash64(F.coalesce("doc_id", "key"), F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    times = taken.select("doc_id", "key", "source", F.floor(F.try_divide("taken", "size") + share).cast("int").alias("times")).where("times > 0").alias("t")
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    rows = docs.withColumn("key", F.xxhash64("text")).alias("d").join(times, F.expr("d.doc_id <=> t.doc_id and d.key = t.key and d.source <=> t.source"))
    return rows.select("d.*", "times").withColumn("copy", copies).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("packing", packed),
]

#: Tokenizers, shingle components and hashed n-grams have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
