"""The write gate: which class and status an edge gets, as one chain of conditions.

Types and relations are joined once; every rule is a column, so the whole gate
is one stage after the joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import graphs
from factloom.scratch import staged

BYPASS, CORRECTION_BYPASS = 0.95, 0.9


def typed(edges: DataFrame, types: DataFrame, rels: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """Edges with their relation's row, the stored types of head and tail (null if unknown), and for those unknown the type of the nearest ancestor."""
    known, rows = types.where("lower(entity_type) <> 'unknown'"), edges
    sides = (("subject", "head"), ("object", "tail"))
    for end, name in sides:
        rows = rows.join(known.select(F.col("entity_id").alias(end), F.col("entity_type").alias(name)), end, "left")
    if hierarchy is None:
        rows = rows.withColumns({f"{name}_walked": F.lit(None).cast("string") for _, name in sides})
    else:
        rows = staged(rows, "gate-edges")  # the edges are shuffled once for each end; only ends without a type are walked
        ends = staged(reduce(DataFrame.union, [rows.where(F.col(name).isNull()).select(F.col(end).alias("entity_id")) for end, name in sides]).distinct(), "gate-ends")
        walked = staged(graphs.nearest_type(hierarchy, types, ends).select("start", F.col("entity_type").alias("found")), "gate-walked")
        for end, name in sides:
            rows = rows.join(walked.select(F.col("start").alias(end), F.col("found").alias(f"{name}_walked")), end, "left")
    return rows.join(rels, "rel_type", "left")


def allows(kinds: Column, kind: Column) -> Column:
    lowered = F.transform(kinds, F.lower)
    return F.array_contains(lowered, "any") | F.array_contains(lowered, F.lower(kind))


def _only(kinds: str, word: str) -> Column:
    return (F.size(kinds) == 1) & (F.lower(F.get(kinds, F.lit(0))) == word)


def type_reason() -> Column:
    """Why an edge of ``typed`` passes or fails its relation's types.

    An unknown end takes the type of its nearest ancestor; if that is not
    allowed, the relation is the wrong one (hierarchy_type_mismatch).  An end
    without any type passes as type_unknown.  Stored types that are not allowed
    are a type_mismatch.
    """
    any_head = F.col("head_types").isNull() | _only("head_types", "any")
    any_tail = F.col("tail_types").isNull() | _only("tail_types", "any")
    scalar = F.coalesce(_only("tail_types", "scalar"), F.lit(False))
    head, tail = F.coalesce("head", "head_walked"), F.coalesce("tail", "tail_walked")
    head_ok, tail_ok = any_head | allows(F.col("head_types"), head), any_tail | allows(F.col("tail_types"), tail)
    return (
        F.when(F.col("head_types").isNull() & F.col("tail_types").isNull() | (any_head & any_tail), F.lit("unconstrained"))
        .when(scalar, F.when(any_head | F.coalesce(head_ok, F.lit(False)), F.lit("valid")).when(head.isNull(), F.lit("type_unknown")).otherwise(F.lit("type_mismatch")))
        .when(head.isNull(), F.lit("type_unknown"))
        .when(F.col("head").isNull() & ~head_ok, F.lit("hierarchy_type_mismatch"))
        .when(tail.isNull(), F.lit("type_unknown"))
        .when(F.col("tail").isNull() & ~tail_ok, F.lit("hierarchy_type_mismatch"))
        .when(head_ok & tail_ok, F.lit("valid"))
        .otherwise(F.lit("type_mismatch"))
    )


def inferred_types(rows: DataFrame) -> DataFrame:
    """(entity_id, entity_type): the first allowed type for ends of ``typed`` that have none, the least of several relations'."""
    one = lambda end, name: rows.where(F.col(name).isNull() & F.col(f"{name}_walked").isNull() & ~_only(f"{name}_types", "any") & ~_only(f"{name}_types", "scalar"))
    ends = [one(end, name).select(F.col(end).alias("entity_id"), F.get(f"{name}_types", F.lit(0)).alias("entity_type")) for end, name in (("subject", "head"), ("object", "tail"))]
    return ends[0].unionByName(ends[1]).where("entity_type is not null").groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"))


def cross_type() -> Column:
    """Whether concrete heads and concrete tails have no type in common."""
    concrete = lambda c: F.filter(c, lambda x: ~x.isin("ANY", "SCALAR"))
    heads, tails = concrete("head_types"), concrete("tail_types")
    return (F.size(heads) > 0) & (F.size(tails) > 0) & ~F.arrays_overlap(heads, tails)


def unified_confidence(source: Column, confidence: Column, frequency: Column, threshold: Column) -> Column:
    """One number from who said it, how sure they were and how often it came."""
    engine = F.least(F.lit(1.0), 0.6 * confidence)
    model = 0.5 * F.least(F.lit(1.0), frequency / F.greatest(threshold, F.lit(1.0))) + 0.5 * confidence
    return F.when(source == "user", F.lit(1.0)).when(source == "engine", engine).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), model)))


def route(confidence: Column, provenance: Column) -> Column:
    """Storage class: A for the user's own, B for sure ones, C for the rest."""
    return F.when(provenance == "user_stated", F.lit("A")).when(confidence >= 0.6, F.lit("B")).otherwise(F.lit("C"))


def gate(edges: DataFrame, types: DataFrame, rels: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """Status and class of each edge.

    A sure edge (0.95, or a correction of 0.9) passes without a type test, but
    one whose types are known to conflict is set aside as class C, unless the
    user wrote it.  Others are tested: unknown relation, types, then conflict
    with other objects of their subject and relation.
    """
    rows = typed(edges, types, rels, hierarchy).where("subject is not null and rel_type is not null")
    several = rows.groupBy("subject", "rel_type").agg((F.min("object") < F.max("object")).alias("several")).where("several")
    rows = rows.join(staged(several, "gate-several"), ["subject", "rel_type"], "left").withColumn("reason", type_reason())
    correction = F.coalesce("is_correction", F.lit(False))
    own = (F.col("provenance") == "user_stated") | correction
    clash = F.col("reason").isin("type_mismatch", "hierarchy_type_mismatch")
    sure = (F.col("confidence") >= BYPASS) | (correction & (F.col("confidence") >= CORRECTION_BYPASS))
    status = (
        F.when(F.col("head_types").isNull() & (F.col("confidence") < 0.9), F.lit("novel_unapproved"))
        .when((F.col("confidence") >= BYPASS) & clash & ~own, F.lit("valid_staged"))
        .when(sure, F.lit("valid"))
        .when(F.col("reason") == "type_mismatch", F.lit("type_mismatch"))
        .when(F.col("reason") == "hierarchy_type_mismatch", F.when(own, F.lit("valid")).otherwise(F.lit("hierarchy_flagged")))
        .when(F.col("several"), F.lit("conflict"))
        .otherwise(F.lit("valid"))
    )
    named = [c for c in ("id", "subject", "rel_type", "object") if c in edges.columns]
    return rows.select(*named, "reason", status.alias("status"), F.when(status == "valid_staged", F.lit("C")).otherwise(route(F.col("confidence"), F.col("provenance"))).alias("fact_class"))


SHAPE_KEYS = ("subject", "object", "rel_type")


def shape_error(edges: DataFrame) -> DataFrame:
    """Edges with the first of their required fields that is missing or blank."""
    missing = F.coalesce(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in SHAPE_KEYS])
    return edges.withColumn("missing", missing)
