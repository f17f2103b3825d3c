"""Exact dedup by content hash.

Texts are equal when identical after lowering A-Z.  They are grouped by their
128-bit hash; of a group the row with the largest doc_id stays.  The bytes of
the texts of every group of two or more are compared through their least and
greatest text; a group where these differ is split by the text itself, so a
collision of hashes never drops a document.  Counts and ids are aggregated
before the shuffle, so a large group of copies costs a few rows a task.

Defined cases: null text counts as empty; rows that repeat a doc_id and its
text are one document and share its decision; null doc_ids stay unless their
group has a doc_id; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), normalised().alias("norm"))
    texts = texts.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("h"))
    keys = staged(texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-keys")
    bytes_of = texts.groupBy("h").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    collided = staged(bytes_of.where("low <> high").select("h"), "exact-collided")
    if collided.isEmpty():
        rows = keys.withColumn("twin", F.lit(""))
    else:
        split = texts.join(collided, "h", "left_semi").select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.concat(F.lit("="), "norm").alias("twin"))
        rows = keys.join(collided, "h", "left_anti").withColumn("twin", F.lit("")).unionByName(split)
    groups = rows.groupBy("h", "twin").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, ["h", "twin"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
