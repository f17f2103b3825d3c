"""Similarity, fusion and selection of ranked rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUSION_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for nulls, different lengths and vectors without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def top_cosine(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k vectors most similar to the one of ``query``: a limit of the feature, kept per task before it is merged."""
    one = F.broadcast(query.select(F.col("embedding").alias("query")).limit(1))
    scored = vectors.crossJoin(one).select("vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def fuse(rankings: list[DataFrame]) -> DataFrame:
    """Reciprocal-rank fusion of rankings (vec_id, score), each a bounded top-k."""
    place = Window.orderBy(F.desc("score"), "vec_id")
    ranked = [r.withColumn("place", F.row_number().over(place) - 1) for r in rankings]
    every = reduce(DataFrame.unionByName, ranked)
    return every.groupBy("vec_id").agg(F.round(F.sum(1.0 / (FUSION_K + F.col("place"))), 6).alias("fused"), F.max("score").alias("best"))


def inject(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """Class A always, B and C from the threshold; a key without such B or C keeps all its rows."""
    lower = F.col("fact_class").isin("B", "C")
    passing = lower & (F.col("confidence") >= threshold)
    some = rows.groupBy(key).agg(F.bool_or(passing).alias("some"))
    return rows.join(some, key).where((F.col("fact_class") == "A") | passing | ~F.col("some")).drop("some")
