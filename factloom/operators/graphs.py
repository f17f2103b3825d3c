"""Walks and lookups over typed edges.

Walks join the frontier with the edges once per level: upward to a fixed depth,
downward to the end.  Edges and every level are tables of the scratch folder, so
that no level's plan repeats those before it, and a level holds each pair of
start and node once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import staged

MAX_DEPTH = 4


def walk_up(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(start, node, depth): all ancestors of each start, the start itself at depth 0."""
    level = starts.select(F.col("entity_id").alias("start"), F.col("entity_id").alias("node"), F.lit(0).alias("depth"))
    levels = [level]
    steps = staged(edges.select(F.col("subject").alias("node"), F.col("object").alias("above")), "walk-edges")
    for d in range(1, depth + 1):
        level = staged(level.join(steps, "node").select("start", F.col("above").alias("node"), F.lit(d).alias("depth")).distinct(), "walk-level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def walk_down(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): all that hangs below each root, at its least depth; a pair that was met before is not walked again, so cycles end."""
    steps = staged(edges.select(F.col("object").alias("node"), F.col("subject").alias("below")).distinct(), "walk-edges")
    level = staged(roots.select(F.col("entity_id").alias("root"), F.col("entity_id").alias("node"), F.lit(0).alias("depth")).distinct(), "walk-level")
    levels = [level]
    while True:
        met = reduce(DataFrame.unionByName, levels).select("root", F.col("node").alias("below"))
        onward = level.join(steps, "node").select("root", "below").distinct().join(met, ["root", "below"], "left_anti")
        level = staged(onward.select("root", F.col("below").alias("node"), F.lit(len(levels)).alias("depth")), "walk-level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def nearest_type(edges: DataFrame, types: DataFrame, starts: DataFrame) -> DataFrame:
    """The type of each start's nearest ancestor whose type is known."""
    known = types.where("entity_type <> 'unknown'").withColumnRenamed("entity_id", "node")
    walked = walk_up(edges, starts).join(known, "node")
    return walked.groupBy("start").agg(F.min_by("entity_type", F.struct("depth", "node")).alias("entity_type"), F.min("depth").cast("long").alias("depth"))


def members_below(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, depth, n): how many members lie at each least depth below each root, to the end."""
    return walk_down(edges, roots).where("depth > 0").groupBy("root", "depth").agg(F.count("*").alias("n"))


def one_hop(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges that touch an anchor on either side, as a union of two joins on equality."""
    out = edges.join(anchors.withColumnRenamed("entity_id", "subject"), "subject", "left_semi").withColumn("side", F.lit("subject"))
    into = edges.join(anchors.withColumnRenamed("entity_id", "object"), "object", "left_semi").withColumn("side", F.lit("object"))
    columns = ["subject", "rel_type", "object", "side"]
    return out.select(*columns).unionByName(into.select(*columns))


def identity_set(same_as: DataFrame, users: DataFrame) -> DataFrame:
    """(user, member): each user and the ids one same_as edge away, on either side."""
    me = users.select(F.col("entity_id").alias("user"))
    there = me.join(same_as, me["user"] == same_as["subject"]).select("user", F.col("object").alias("member"))
    back = me.join(same_as, me["user"] == same_as["object"]).select("user", F.col("subject").alias("member"))
    return me.select("user", F.col("user").alias("member")).unionByName(there).unionByName(back).distinct()


def taxonomy_bridge(taxonomies: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges counted by the taxonomies whose defining relations hold theirs."""
    bridge = taxonomies.select("taxonomy", F.explode("defining_rels").alias("rel_type"))
    counts = edges.groupBy("rel_type").agg(F.count("*").alias("n"))  # a row a relation meets the taxonomies, so no task has all edges of one
    return counts.join(bridge, "rel_type").groupBy("taxonomy", "rel_type").agg(F.sum("n").alias("n"))


def membership(edges: DataFrame, types: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """Per edge: ok if both ends' types are in one taxonomy that the relation defines, violation if only one is, else unconstrained."""
    members = taxonomies.select("taxonomy", F.explode("members").alias("kind"))
    defined = taxonomies.select("taxonomy", F.explode("defining_rels").alias("rel_type"))
    head = types.select(F.col("entity_id").alias("subject"), F.col("entity_type").alias("head"))
    tail = types.select(F.col("entity_id").alias("object"), F.col("entity_type").alias("tail"))
    typed = edges.join(head, "subject").join(tail, "object").join(defined, "rel_type", "left")
    h = members.select("taxonomy", F.col("kind").alias("head"), F.lit(1).alias("h"))
    t = members.select("taxonomy", F.col("kind").alias("tail"), F.lit(1).alias("t"))
    marked = typed.join(h, ["taxonomy", "head"], "left").join(t, ["taxonomy", "tail"], "left")
    sides = F.coalesce(F.max(F.coalesce("h", F.lit(0)) + F.coalesce("t", F.lit(0))), F.lit(0))
    status = F.when(sides == 2, F.lit("ok")).when(sides == 1, F.lit("violation")).otherwise(F.lit("unconstrained"))
    return marked.groupBy("subject", "rel_type", "object").agg(status.alias("status"))


def own_or_parent_facts(concepts: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each concept's own facts; a concept without any has those of its parents, one level up."""
    own = concepts.join(facts.withColumnRenamed("subject", "entity_id"), "entity_id").select("entity_id", "rel_type", "object", F.lit("own").alias("via"))
    bare = concepts.join(facts.select(F.col("subject").alias("entity_id")), "entity_id", "left_anti")
    parents = bare.join(edges.select(F.col("subject").alias("entity_id"), F.col("object").alias("parent")), "entity_id")
    lent = parents.join(facts.withColumnRenamed("subject", "parent"), "parent").select("entity_id", "rel_type", "object", F.lit("parent").alias("via"))
    return own.unionByName(lent)


def retract_targets(wanted: DataFrame, facts: DataFrame, staged: DataFrame) -> DataFrame:
    """What each request (entity_id, object) retracts: facts by subject and object, else facts by object, else staged on either side."""
    first = wanted.join(facts, (F.col("entity_id") == F.col("subject")) & (F.col("wanted") == F.col("object"))).select("entity_id", "id", F.lit(1).alias("rung"))
    second = wanted.join(facts, F.col("entity_id") == F.col("object")).select("entity_id", "id", F.lit(2).alias("rung"))
    either = staged.select("id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity_id"))
    third = wanted.select("entity_id").join(either, "entity_id").select("entity_id", "id", F.lit(3).alias("rung"))
    every = first.unionByName(second).unionByName(third)
    best = every.groupBy("entity_id").agg(F.min("rung").alias("rung"))
    return every.join(best, ["entity_id", "rung"]).select("entity_id", F.col("rung").cast("long").alias("rung"), "id")


def canonical_ladder(edges: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact relation, else alias (swapping the ends if it inverts), else none."""
    exact = known.select("rel_type", F.lit(True).alias("exact"))
    other = aliases.select(F.col("alias").alias("rel_type"), "canonical", "requires_inversion")
    found = edges.join(exact, "rel_type", "left").join(other, "rel_type", "left")
    turned = F.col("exact").isNull() & F.coalesce("requires_inversion", F.lit(False))
    return found.select(
        F.when(turned, F.col("object")).otherwise(F.col("subject")).alias("subject"),
        F.when(F.col("exact"), F.col("rel_type")).otherwise(F.col("canonical")).alias("rel_type"),
        F.when(turned, F.col("subject")).otherwise(F.col("object")).alias("object"),
        F.when(F.col("exact"), F.lit("exact")).when(F.col("canonical").isNotNull(), F.lit("alias")).otherwise(F.lit("none")).alias("rung"),
    )


def nested_members(edges: DataFrame, severed: DataFrame) -> DataFrame:
    """(root, member, depth): all members below each family (family, member), to the end, without severed edges and what hangs on them."""
    kept = edges.join(severed, ["family", "member"], "left_anti")
    turned = kept.select(F.col("family").alias("object"), F.col("member").alias("subject"))
    return walk_down(turned, kept.select(F.col("family").alias("entity_id")).distinct()).where("depth > 0 and root <> node").select("root", F.col("node").alias("member"), "depth")
