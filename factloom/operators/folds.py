"""Folds of assertion logs to current views.

Tables are append-only: every change is a row, and these folds give the state
that the rows lead to, in the order of (ts, id).  All are keyed aggregations
with partial sums before the shuffle, or windows over one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ["subject", "rel_type", "object"]
CONFLICT_PENALTY = 0.5

#: How strongly a source may set the preferred alias.
ALIAS_RANKS = {"user_stated": 5, "rel_default": 4, "inferred": 3, "merge": 2, "provisioned": 1, "unspecified": 0}


def _order() -> Column:
    return F.struct("ts", "id")


def triple_upsert(log: DataFrame) -> DataFrame:
    """One row per triple: best class, repeats, latest and first confidence, and provenance that only moves to user_stated."""
    return log.groupBy(*TRIPLE).agg(
        F.min("fact_class").alias("fact_class"),
        F.count("*").alias("confirmed_count"),
        F.max_by("confidence", _order()).alias("unified_confidence"),
        F.min_by("confidence", _order()).alias("confidence"),
        F.when(F.bool_or(F.col("provenance") == "user_stated"), F.lit("user_stated")).otherwise(F.min_by("provenance", _order())).alias("provenance"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("last_seen_at"),
    )


def class_max(log: DataFrame) -> DataFrame:
    """The best class of each triple; a class never falls."""
    return log.groupBy(*TRIPLE).agg(F.min("fact_class").alias("fact_class"))


def highest_confidence(log: DataFrame) -> DataFrame:
    """The row of highest confidence of each triple; ties to the latest."""
    best = F.max_by(F.struct("id", "confidence", "fact_class", "ts"), F.struct("confidence", "ts", "id"))
    return log.groupBy(*TRIPLE).agg(best.alias("x")).select(*TRIPLE, "x.*")


def preferred_alias(aliases: DataFrame) -> DataFrame:
    """The preferred alias of each entity: highest source rank, and the latest among equals."""
    rank = F.coalesce(*[F.when(F.col("source") == name, F.lit(n)) for name, n in ALIAS_RANKS.items()], F.lit(0))
    ranked = aliases.withColumn("rank", rank)
    best = F.max_by(F.struct("alias", "source", "rank"), F.struct("rank", "ts", "id"))
    return ranked.groupBy("entity_id").agg(best.alias("x")).select("entity_id", "x.alias", "x.source", F.col("x.rank").cast("long").alias("rank"))


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Aliases that several entities claim: the first keeps it, the others are in conflict."""
    return aliases.groupBy("alias").agg(F.count_distinct("entity_id").alias("n_entities"), F.min("entity_id").alias("keeper")).where("n_entities > 1")


def contradict(log: DataFrame) -> DataFrame:
    """Each assertion less 0.5 for every later one of its subject and relation with another object, not below 0."""
    ahead = Window.partitionBy("subject", "rel_type").orderBy("ts", "id").rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy(*TRIPLE).orderBy("ts", "id").rowsBetween(1, Window.unboundedFollowing)
    against = F.count("*").over(ahead) - F.count("*").over(same)
    return log.withColumn("contradictions", against).withColumn("confidence_now", F.greatest(F.col("confidence") - CONFLICT_PENALTY * F.col("contradictions"), F.lit(0.0)))


def current_view(log: DataFrame) -> DataFrame:
    """The latest assertion of each subject and relation."""
    newest = F.max_by(F.struct("object", "confidence", "ts", "id"), _order())
    return log.groupBy("subject", "rel_type").agg(newest.alias("x"), F.count("*").alias("versions")).select("subject", "rel_type", "x.*", "versions")


def tombstones(log: DataFrame, forgets: Column, restores: Column) -> DataFrame:
    """The state of each subject and object after forgets, restores and assertions: the last forget or restore decides."""
    act = F.when(forgets, F.lit("forgotten")).when(restores, F.lit("live"))
    return log.withColumn("act", act).groupBy("subject", "object").agg(
        F.coalesce(F.max_by("act", F.when(F.col("act").isNotNull(), _order())), F.lit("live")).alias("state"),
        F.count("*").alias("n"),
    )


def widen_types(kinds: DataFrame) -> DataFrame:
    """The union of all type lists of a relation; nothing, an empty list or ANY widens to ANY."""
    open_ended = F.bool_or(F.col("types").isNull() | (F.size("types") == 0) | F.array_contains("types", "ANY"))
    merged = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), ",")
    return kinds.groupBy("rel_type").agg(F.when(open_ended, F.lit("ANY")).otherwise(merged).alias("types"))


def reconcile(current: DataFrame, seed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Take the seed's columns where they differ, nulls included; rows of source user stay."""
    joined = current.alias("c").join(seed.alias("s"), key, "left")
    differs = ~F.lit(True)
    for name in columns:
        differs = differs | ~F.col(f"c.{name}").eqNullSafe(F.col(f"s.{name}"))
    take = F.col("s.present").isNotNull() & (F.col("c.source") != "user") & differs
    chosen = [F.when(take, F.col(f"s.{name}")).otherwise(F.col(f"c.{name}")).alias(name) for name in columns]
    return joined.select(key, F.col("c.source").alias("source"), *chosen, take.alias("changed"))


def mutually_exclusive(log: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs of subject and object that hold both of two relations which exclude one another; the later one wins."""
    of = lambda rel: F.max(F.when(F.col("rel_type") == rel, _order()))
    both = log.where(F.col("rel_type").isin(first, second)).groupBy("subject", "object").agg(of(first).alias("a"), of(second).alias("b"))
    return both.where("a is not null and b is not null").select("subject", "object", F.when(F.col("a") > F.col("b"), F.lit(first)).otherwise(F.lit(second)).alias("kept"))


def symmetric_dedup(edges: DataFrame) -> DataFrame:
    """One row of each unordered pair."""
    return edges.groupBy(F.least("subject", "object").alias("low"), F.greatest("subject", "object").alias("high"), "rel_type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def complete_inverses(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """The edges and, for relations with an inverse, the swapped edges; of equals the higher confidence."""
    pairs = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    swapped = edges.select(F.col("object").alias("subject"), F.element_at(pairs, F.col("rel_type")).alias("rel_type"), F.col("subject").alias("object"), "confidence").where("rel_type is not null")
    return edges.select("subject", "rel_type", "object", "confidence").unionByName(swapped).groupBy(*TRIPLE).agg(F.max("confidence").alias("confidence"))
