"""Where outputs of models go, and what is known of candidates before that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind of output -> least confidence to be stored at once, and to be staged.
LIMITS = {"fact": (0.9, 0.6), "retraction_signal": (0.85, 0.6)}
STAGED = ["entity_type", "rel_type", "context"]
CATEGORIES = ["family", "identity", "location", "work", "physical", "temporal", "pets", "other"]
TALLIES = ["approved", "mapped", "rejected", "held"]


def route(kind: Column, confidence: Column) -> Column:
    """direct, staged, rejected or hold."""
    by_limit = [F.when(kind == name, F.when(confidence >= high, F.lit("direct")).when(confidence >= low, F.lit("staged")).otherwise(F.lit("rejected"))) for name, (high, low) in LIMITS.items()]
    return F.coalesce(*by_limit, F.when(kind.isin(STAGED), F.lit("staged")), F.lit("hold"))


def tally(routed: DataFrame) -> DataFrame:
    """(outcome, n) for the four outcomes that are reported; of the decisions only rejected bears the name of one."""
    names = routed.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in TALLIES])).alias("outcome"))
    counted = routed.groupBy(F.col("decision").alias("outcome")).agg(F.count("*").alias("n"))
    return names.join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def metadata_valid(row: DataFrame) -> Column:
    """Whether inferred metadata of a relation is whole: all six fields, a confidence of 0 to 1, an inverse unless symmetric, a known category."""
    whole = F.lit(True)
    for name in ("is_symmetric", "head_types", "tail_types", "is_hierarchy_rel", "category", "confidence"):
        whole = whole & row[name].isNotNull()
    inverse = F.coalesce(row["inverse_rel_type"], F.lit("")) != ""
    return F.coalesce(whole & row["confidence"].between(0.0, 1.0) & (row["is_symmetric"] | inverse) & F.lower(row["category"]).isin(CATEGORIES), F.lit(False))


def correction_confidence(confidence: Column, matched: Column) -> Column:
    """What a model's confidence and a matched pattern together say that a text is a correction."""
    return (
        F.when((confidence >= 0.75) & matched, 0.95)
        .when(confidence >= 0.75, 0.85)
        .when((confidence >= 0.65) & matched, 0.75)
        .when(matched, 0.65)
        .otherwise(0.0)
    )


def pending(candidates: DataFrame, most: int) -> DataFrame:
    """The undecided candidates that were seen most often, a queue of the stated length."""
    return candidates.where("decision is null").orderBy(F.desc("occurrences"), "candidate").limit(most)


def feedback_bins(rows: DataFrame) -> DataFrame:
    """Feedback counted by user, kind and tenth of confidence."""
    bin_of = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int")
    return rows.groupBy("user", bin_of.alias("bin"), "kind").agg(F.count("*").alias("n"))


def document_summary(chunks: DataFrame) -> DataFrame:
    """Sums of a document's chunks (committed, staged, context, failed) and how it went as a whole."""
    sums = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), *[F.sum(c).alias(c) for c in ("committed", "staged", "context", "failed")])
    status = F.when(F.col("failed") == 0, F.lit("ok")).when(F.col("failed") >= F.col("chunks"), F.lit("failed")).otherwise(F.lit("partial"))
    return sums.withColumn("status", status)


def register_aliases(claims: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(entity_id, alias, preferred, conflict) after claims (id, entity_id, alias, source, preferred) in order.

    The first entity that claims an alias keeps it; for others it is in conflict
    and never preferred.  A claim takes an entity's preference unless its source
    is weaker than that of the incumbent, so the last of the strongest so far
    holds it: of the claims that ask, the one of highest rank, then latest.
    """
    rank = F.coalesce(*[F.when(F.col("source") == name, F.lit(n)) for name, n in ranks.items()], F.lit(0))
    owner = F.min(F.struct("id", "entity_id")).over(Window.partitionBy("alias"))
    rows = claims.withColumn("rank", rank).withColumn("conflict", owner["entity_id"] != F.col("entity_id"))
    asks = F.when(F.col("preferred") & ~F.col("conflict"), F.struct("rank", "id"))
    best = F.max(asks).over(Window.partitionBy("entity_id"))
    rows = rows.withColumn("holds", F.coalesce(asks == best, F.lit(False)))
    return rows.groupBy("entity_id", "alias").agg(F.bool_or("holds").alias("preferred"), F.bool_or("conflict").alias("conflict"))
