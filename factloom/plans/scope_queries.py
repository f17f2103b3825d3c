"""Scopes of requests, and the small rules around reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import scopes
from factloom.plans.language_queries import quoted
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

PERIODS = ["1995-03-01", "1994-01-01/1994-06-30", "never", "1998-01-01/1997-01-01"]


@register(
    "valid_in_scope",
    f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f"('{p}')" for p in PERIODS)}) AS t(scope)), f AS (
        SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS since, CAST(l_shipdate AS DATE) AS until, {quoted(PERIODS)}[l_linenumber % 4 + 1] AS scope FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    ) SELECT l_orderkey, l_linenumber FROM f WHERE CASE l_linenumber % 4 WHEN 0 THEN since <= DATE '1995-03-01' AND until > DATE '1995-03-01' WHEN 1 THEN since <= DATE '1994-06-30' AND until > DATE '1994-01-01' ELSE true END""",
)
def valid_in_scope(spark, folder):
    """Lines on their way (ordered, not yet shipped) in the scope that is asked for."""
    orders = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("valid_from"))
    rows = src.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("valid_until")).join(orders, "l_orderkey")
    asked = F.element_at(F.array(*map(F.lit, PERIODS)), F.col("l_linenumber").cast("int") % 4 + 1)
    return scopes.valid_in(rows, asked).select("l_orderkey", "l_linenumber")


ASKS = ["forget all my pets", "I don't have any children", "no job for now", "delete all", "I had a dog", "we have no dog and no family", ""]


@register(
    "retraction_scope",
    f"""WITH t AS (
        SELECT event_id AS key, lower({quoted(ASKS)}[event_id % 7 + 1] || ' ' || event_type) AS low FROM events UNION ALL SELECT -1 - (conv_id * 1000 + turn), lower(text) FROM conversations
    ), w AS (
        SELECT *, regexp_matches(low, 'don''t have any|don''t have a|no |forget all|delete all') AS whole FROM t
    ), c AS (
        SELECT key, CASE WHEN NOT whole THEN NULL WHEN regexp_matches(low, 'pet|dog|cat|animal') THEN 'pets' WHEN regexp_matches(low, 'family|child|parent|sibling|spouse') THEN 'family' WHEN regexp_matches(low, 'work|job|employer|project|occupation') THEN 'work' END AS category FROM w
    ) SELECT key, CASE WHEN category IS NULL THEN 'granular' ELSE 'categorical' END AS scope_level, category, CASE WHEN category IS NULL THEN '' ELSE 'of_' || category END AS rels FROM c""",
)
def retraction_scope(spark, folder):
    """Whether what is said takes back a whole group; there is no group of places."""
    events = src.table(spark, folder, "events").select(F.col("event_id").alias("key"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ASKS)), (F.col("event_id") % 7 + 1).cast("int")), "event_type").alias("text"))
    said = src.table(spark, folder, "conversations").select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("key"), "text")
    names = spark.createDataFrame([(g, [f"of_{g}"], ["Thing"]) for g in ("family", "pets", "work")], "taxonomy_name string, defining_rels array<string>, members array<string>")
    found = scopes.group_scope(events.unionByName(said), names)
    return found.select("key", "scope_level", "category", F.array_join("rel_types", ",").alias("rels"))


@register(
    "attribute_heads",
    """WITH a AS (SELECT p_partkey, replace(lower(p_name), ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '_of' ELSE '' END AS attribute, string_split(lower(p_name), ' ') AS ws FROM part),
    b AS (SELECT min(text) AS text FROM benchmark), q AS (SELECT list(DISTINCT w) AS words FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, p_size FROM part) WHERE p_size < 10)
    SELECT p_partkey, list_contains(words, list_filter(ws, lambda w: w NOT IN ('in', 'at', 'on', 'of', 'for', 'from', 'by', 'as', 'into', 'to', 'with', 'about'))[-1]) AS about FROM a, q""",
)
def attribute_heads(spark, folder):
    """Whether a query of the words of small parts is about an attribute named like a part."""
    part = src.table(spark, folder, "part")
    words = part.where("p_size < 10").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).agg(F.collect_set("w").alias("words"))
    attribute = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, "_of").otherwise(""))
    return part.join(words).select("p_partkey", scopes.about_attribute(attribute, F.col("words")).alias("about"))


@register(
    "retrieval_order",
    f"""WITH {src.ASSERTIONS}, f AS (
        SELECT DISTINCT subject, rel_type, object, confidence FROM assertions WHERE fact_class <> 'C'
    ), h AS (
        SELECT DISTINCT subject, rel_type, object, confidence FROM assertions a WHERE fact_class = 'C' AND confidence >= 0.6 AND NOT EXISTS (SELECT 1 FROM f WHERE f.subject = a.subject AND f.rel_type = a.rel_type AND f.object = a.object)
    ), u AS (
        SELECT subject AS who, subject, rel_type, object, confidence, 'facts' AS source FROM f UNION ALL SELECT subject, subject, rel_type, object, confidence, 'vectors' FROM h
    ) SELECT *, row_number() OVER (PARTITION BY who ORDER BY confidence DESC NULLS LAST, source, subject, rel_type, object) AS position FROM u""",
)
def retrieval_order(spark, folder):
    """Facts of classes A and B as stored, those of class C as found by vectors."""
    rows = src.assertions(spark, folder).select(F.col("subject").alias("who"), "subject", "rel_type", "object", "confidence", "fact_class")
    stored, hits = rows.where("fact_class <> 'C'").drop("fact_class").distinct(), rows.where("fact_class = 'C'").drop("fact_class").distinct()
    return scopes.retrieved(stored, hits, "who", 0.6)


@register("unsure_edges", f"WITH {src.ASSERTIONS} SELECT id, 'store' AS lane FROM assertions WHERE confidence >= 0.4 OR confidence IS NULL UNION ALL SELECT id, 'context' FROM assertions WHERE confidence < 0.4")
def unsure_edges(spark, folder):
    kept, context = scopes.split_by_confidence(src.assertions(spark, folder).select("id", "confidence"))
    return kept.select("id", F.lit("store").alias("lane")).unionByName(context.select("id", F.lit("context").alias("lane")))


@register(
    "scalar_history",
    """WITH r AS (SELECT event_type AS rel_type, count(*) % 2 = 0 AS scalar FROM events GROUP BY event_type)
    SELECT user_id AS subject, event_type AS rel_type, props ->> '$.k' AS object, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE event_type IN (SELECT rel_type FROM r WHERE scalar) GROUP BY ALL""",
)
def scalar_history(spark, folder):
    events = src.table(spark, folder, "events")
    tails = F.when(F.count("*") % 2 == 0, F.array(F.lit("Any"), F.lit("SCALAR"))).otherwise(F.array(F.lit("Object")))
    relations = events.groupBy(F.col("event_type").alias("rel_type")).agg(tails.alias("tail_types"))
    facts = events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("rel_type"), F.get_json_object("props", "$.k").alias("object"), "ts")
    return scopes.scalar_history(facts, relations)


@register(
    "materialised_facts",
    """WITH f AS (SELECT l_suppkey AS subject, l_partkey AS object, count(*) AS n, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY ALL)
    SELECT subject, 'supplies' AS rel_type, object, CAST(n AS BIGINT) AS confirmed_count FROM f WHERE n >= 2 AND object % 3 <> 0 AND NOT (returned AND n > 2)""",
)
def materialised_facts(spark, folder):
    """Supplies that lines confirmed twice, of parts that are of class B, where no fact of a return stands for them yet."""
    counted = src.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object")).agg(F.count("*").alias("confirmed_count"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    rows = counted.withColumn("rel_type", F.lit("supplies")).withColumns({c: F.lit(None).cast("timestamp") for c in ("promoted_at", "deleted_at", "superseded_at")}).withColumn("fact_class", F.when(F.col("object") % 3 == 0, "C").otherwise("B"))
    return scopes.materialised(rows.where("returned and confirmed_count > 2"), rows, confirmations=2).select("subject", "rel_type", "object", "confirmed_count")


@register(
    "type_recheck",
    """WITH k AS (
        SELECT lower(p_brand) AS rel_type, list(DISTINCT lower(p_type)) FILTER (p_size > 40) AS heads, CASE WHEN min(p_size) > 1 THEN ['scalar'] ELSE list(DISTINCT lower(p_type)) FILTER (p_size < 10) END AS tails FROM part GROUP BY ALL
    ), e AS (
        SELECT l_orderkey, l_linenumber, lower(a.p_brand) AS rel_type, lower(a.p_type) AS s, CASE WHEN l_linenumber % 3 = 0 THEN 'unknown' ELSE lower(b.p_type) END AS o FROM lineitem JOIN part a ON a.p_partkey = l_partkey LEFT JOIN part b ON b.p_partkey = l_suppkey
    ) SELECT l_orderkey, l_linenumber, CASE WHEN heads IS NOT NULL AND NOT list_contains(heads, s) THEN 'subject' WHEN tails IS NOT NULL AND tails <> ['scalar'] AND o IS NOT NULL AND o <> 'unknown' AND NOT list_contains(tails, o) THEN 'object' ELSE 'ok' END AS recheck FROM e LEFT JOIN k ON k.rel_type = e.rel_type""",
)
def type_recheck(spark, folder):
    """Lines as edges from their part to the part of their supplier's number, against the types that brands allow."""
    part = src.table(spark, folder, "part")
    kinds = lambda rule: F.collect_set(F.when(rule, F.col("p_type")))
    some = lambda c: F.when(F.size(c) > 0, c)
    relations = part.groupBy(F.col("p_brand").alias("rel_type")).agg(some(kinds(F.col("p_size") > 40)).alias("head_types"), F.when(F.min("p_size") > 1, F.array(F.lit("SCALAR"))).otherwise(some(kinds(F.col("p_size") < 10))).alias("tail_types"))
    ends = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("rel_type"), F.col("p_type").alias("subject_type"))
    others = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_type").alias("object_type"))
    edges = src.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(ends, "l_partkey").join(others, "l_suppkey", "left")
    edges = edges.withColumn("object_type", F.when(F.col("l_linenumber") % 3 == 0, "Unknown").otherwise(F.col("object_type")))
    return scopes.rechecked(edges, relations).select("l_orderkey", "l_linenumber", "recheck")


@register(
    "strict_registry",
    """WITH e AS (SELECT c_custkey AS id, c_nationkey || '-' || c_mktsegment AS name, lower(c_mktsegment) AS kind FROM customer), r AS (
        SELECT name, kind, kind || '-' || (row_number() OVER (PARTITION BY kind ORDER BY name) - 1) AS cid FROM (SELECT DISTINCT c_nationkey || '-' || c_mktsegment AS name, lower(c_mktsegment) AS kind FROM customer WHERE c_nationkey < 5)
    ), k AS (SELECT kind, count(*) AS before FROM r GROUP BY kind), f AS (
        SELECT name, kind, min(id) AS first FROM e WHERE (name, kind) NOT IN (SELECT name, kind FROM r) GROUP BY ALL
    ), m AS (
        SELECT f.name, f.kind, first, f.kind || '-' || (row_number() OVER (PARTITION BY f.kind ORDER BY first, f.name) + coalesce(before, 0) - 1) AS cid FROM f LEFT JOIN k ON k.kind = f.kind
    ) SELECT e.id, coalesce(r.cid, m.cid) AS canonical_id, r.cid IS NOT NULL OR e.id <> m.first AS is_duplicate FROM e LEFT JOIN r ON r.name = e.name AND r.kind = e.kind LEFT JOIN m ON m.name = e.name AND m.kind = e.kind""",
)
def strict_registry(spark, folder):
    """Customers named by nation and segment, of which the first nations are registered."""
    rows = src.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("name"), F.lower("c_mktsegment").alias("type"))
    held = rows.where("c_nationkey < 5").select("name", "type").distinct()
    registry = held.select("name", "type", F.expr("type || '-' || (row_number() OVER (PARTITION BY type ORDER BY name) - 1)").alias("canonical_id"))
    asked = rows.select("id", F.concat(F.lit(" "), F.upper("name")).alias("name"), "type")
    return scopes.registered(asked, registry, rows.select("type").distinct()).select("id", "canonical_id", "is_duplicate")
