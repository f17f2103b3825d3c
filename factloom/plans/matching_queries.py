"""Similar vectors, and answers of models read from damaged texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import replies, similar
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
PAIRS = f"p AS (SELECT a.vec_id AS query, b.vec_id AS id, {COSINE} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {{}} WHERE {COSINE} >= {{}})"


def vectors(spark, folder):
    return src.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@register("similar_vectors", f"WITH {PAIRS.format('a.vec_id < b.vec_id', 0.6)} SELECT query, id, round(s, 6) AS similarity FROM p")
def similar_vectors(spark, folder):
    """Every pair of embeddings with a similarity of 0.6 or more, once."""
    rows = vectors(spark, folder)
    return similar.similar(rows, rows, 0.6).where("query < id").withColumn("similarity", F.round("similarity", 6))


@register(
    "similar_candidates",
    f"""WITH {PAIRS.format('a.vec_id % 20 = 0', 0.3)} SELECT query, id, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 5""",
)
def similar_candidates(spark, folder):
    """The five embeddings most similar to each whose id is divisible by 20, from a similarity of 0.3 on."""
    rows = vectors(spark, folder)
    return similar.similar(rows.where("id % 20 = 0"), rows, 0.3, most=5).withColumn("similarity", F.round("similarity", 6))


@register(
    "model_replies",
    """SELECT conv_id * 1000 + turn AS key, CASE (conv_id + turn) % 6 WHEN 0 THEN 'whole' WHEN 1 THEN 'line' WHEN 2 THEN 'scan' WHEN 3 THEN 'scan' END AS strategy, CASE WHEN (conv_id + turn) % 6 < 4 THEN text END AS content FROM conversations""",
)
def model_replies(spark, folder):
    """Turns as contents of answers: whole, on the second of two lines, between remains of other objects, in an object, cut off, and without choices."""
    said = src.table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), ((F.col("conv_id") + F.col("turn")) % 6).cast("int").alias("case"), "text")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    other = F.to_json(F.struct(F.col("text").alias("delta"), F.lit("a \"}{\" in a string").alias("choice")))
    forms = [body, F.concat(other, F.lit("\n"), body), F.concat(F.lit("data: {broken \"x {"), body, F.lit("}} {")), F.concat(other, F.lit(", {\"data\": "), body, F.lit("} tail")), F.regexp_replace(body, r"\]\}$", ""), other]
    texts = said.select("key", F.element_at(F.array(*forms), F.col("case") + 1).alias("text"))
    schema = "choices array<struct<message: struct<content: string>>>"
    return replies.parsed_replies(texts).select("key", "strategy", F.get(F.from_json("reply", schema)["choices"], F.lit(0))["message"]["content"].alias("content"))
