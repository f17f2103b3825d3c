"""Folds of the assertion log."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import folds
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

LOG = f"WITH {src.ASSERTIONS}"


@register(
    "fold_triple_upsert",
    f"""{LOG} SELECT subject, rel_type, object, min(fact_class) AS fact_class, count(*) AS confirmed_count,
        arg_max(confidence, (ts, id)) AS unified_confidence, arg_min(confidence, (ts, id)) AS confidence,
        CASE WHEN bool_or(provenance = 'user_stated') THEN 'user_stated' ELSE arg_min(provenance, (ts, id)) END AS provenance,
        min(ts) AS created_at, max(ts) AS last_seen_at
    FROM assertions GROUP BY ALL""",
)
def fold_triple_upsert(spark, folder):
    return folds.triple_upsert(src.assertions(spark, folder))


@register("fold_class_max", f"{LOG} SELECT subject, rel_type, object, min(fact_class) AS fact_class FROM assertions GROUP BY ALL")
def fold_class_max(spark, folder):
    return folds.class_max(src.assertions(spark, folder))


@register(
    "dedup_highest_confidence",
    f"""{LOG} SELECT subject, rel_type, object, id, confidence, fact_class, ts FROM assertions
    QUALIFY row_number() OVER (PARTITION BY subject, rel_type, object ORDER BY confidence DESC, ts DESC, id DESC) = 1""",
)
def dedup_highest_confidence(spark, folder):
    return folds.highest_confidence(src.assertions(spark, folder))


@register(
    "prefer_alias_rank",
    """WITH a AS (SELECT event_id AS id, 'user:' || user_id AS entity_id, event_type AS alias, ts,
            ['unspecified', 'inferred', 'provisioned', 'user_stated', 'merge', 'rel_default'][event_id % 6 + 1] AS source FROM events),
        r AS (SELECT *, CAST(CASE source WHEN 'user_stated' THEN 5 WHEN 'rel_default' THEN 4 WHEN 'inferred' THEN 3 WHEN 'merge' THEN 2 WHEN 'provisioned' THEN 1 ELSE 0 END AS BIGINT) AS rank FROM a)
    SELECT entity_id, alias, source, rank FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY rank DESC, ts DESC, id DESC) = 1""",
)
def prefer_alias_rank(spark, folder):
    names = F.array(*[F.lit(x) for x in ("unspecified", "inferred", "provisioned", "user_stated", "merge", "rel_default")])
    events = src.table(spark, folder, "events")
    source = F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))
    return folds.preferred_alias(events.select(F.col("event_id").alias("id"), F.concat(F.lit("user:"), "user_id").alias("entity_id"), F.col("event_type").alias("alias"), "ts", source.alias("source")))


@register("alias_collision", "SELECT p_name AS alias, count(DISTINCT p_partkey) AS n_entities, min(p_partkey) AS keeper FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def alias_collision(spark, folder):
    return folds.alias_collisions(src.table(spark, folder, "part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("entity_id")))


@register(
    "contradict_penalty",
    f"""{LOG}, c AS (SELECT *, count(*) OVER (PARTITION BY subject, rel_type ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
            - count(*) OVER (PARTITION BY subject, rel_type, object ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS contradictions FROM assertions)
    SELECT id, subject, rel_type, object, contradictions, greatest(confidence - 0.5 * contradictions, 0.0) AS confidence_now FROM c""",
)
def contradict_penalty(spark, folder):
    return folds.contradict(src.assertions(spark, folder)).select("id", "subject", "rel_type", "object", "contradictions", "confidence_now")


@register(
    "supersede_current_view",
    f"""{LOG} SELECT subject, rel_type, arg_max(object, (ts, id)) AS object, arg_max(confidence, (ts, id)) AS confidence, max(ts) AS ts, arg_max(id, (ts, id)) AS id, count(*) AS versions
    FROM assertions GROUP BY subject, rel_type""",
)
def supersede_current_view(spark, folder):
    return folds.current_view(src.assertions(spark, folder))


@register(
    "tombstone_dual",
    f"""{LOG}, a AS (SELECT *, CASE WHEN rel_type = 'error' THEN 'forgotten' WHEN rel_type = 'signup' THEN 'live' END AS act FROM assertions)
    SELECT subject, object, coalesce(arg_max(act, (ts, id)) FILTER (act IS NOT NULL), 'live') AS state, count(*) AS n FROM a GROUP BY ALL""",
)
def tombstone_dual(spark, folder):
    """An error about an object forgets it for the user, a signup restores it."""
    return folds.tombstones(src.assertions(spark, folder), F.col("rel_type") == "error", F.col("rel_type") == "signup")


@register(
    "widen_types",
    """WITH k AS (SELECT p_brand AS rel_type, CASE WHEN p_partkey % 97 = 0 THEN ['ANY'] WHEN p_partkey % 89 = 0 THEN NULL ELSE [p_type] END AS types FROM part),
        o AS (SELECT rel_type, bool_or(types IS NULL OR list_contains(types, 'ANY')) AS open FROM k GROUP BY 1),
        u AS (SELECT rel_type, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (SELECT rel_type, unnest(types) AS t FROM k) GROUP BY 1)
    SELECT o.rel_type, CASE WHEN open THEN 'ANY' ELSE types END AS types FROM o LEFT JOIN u USING (rel_type)""",
)
def widen_types(spark, folder):
    kinds = F.when(F.col("p_partkey") % 97 == 0, F.array(F.lit("ANY"))).when(F.col("p_partkey") % 89 == 0, F.lit(None)).otherwise(F.array("p_type"))
    return folds.widen_types(src.table(spark, folder, "part").select(F.col("p_brand").alias("rel_type"), kinds.alias("types")))


@register(
    "reconcile_seed_null_safe",
    """WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS region, CASE WHEN n_nationkey % 3 = 0 THEN 'user' ELSE 'seed' END AS source FROM nation),
        s AS (SELECT n_nationkey AS k, n_name AS name, CAST(CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS BIGINT) AS region FROM nation WHERE n_nationkey % 7 <> 0),
        j AS (SELECT CAST(c.k AS BIGINT) AS k, c.source, c.name AS cn, c.region AS cr, s.name AS sn, s.region AS sr,
            s.k IS NOT NULL AND c.source <> 'user' AND (c.name IS DISTINCT FROM s.name OR c.region IS DISTINCT FROM s.region) AS changed FROM c LEFT JOIN s USING (k))
    SELECT k, source, CASE WHEN changed THEN sn ELSE cn END AS name, CASE WHEN changed THEN sr ELSE cr END AS region, changed FROM j""",
)
def reconcile_seed_null_safe(spark, folder):
    key = F.col("n_nationkey").cast("long")
    nation = src.table(spark, folder, "nation")
    current = nation.select(
        key.alias("k"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("name"),
        F.col("n_regionkey").cast("long").alias("region"),
        F.when(key % 3 == 0, F.lit("user")).otherwise(F.lit("seed")).alias("source"),
    )
    seed = nation.where(key % 7 != 0).select(key.alias("k"), F.col("n_name").alias("name"), (F.col("n_regionkey") + F.when(key % 4 == 0, 1).otherwise(0)).cast("long").alias("region"), F.lit(True).alias("present"))
    return folds.reconcile(current, seed, "k", ["name", "region"])


@register(
    "mutual_exclusion",
    f"""{LOG}, p AS (SELECT subject, object, max((ts, id)) FILTER (rel_type = 'click') AS a, max((ts, id)) FILTER (rel_type = 'view') AS b FROM assertions GROUP BY ALL)
    SELECT subject, object, CASE WHEN a > b THEN 'click' ELSE 'view' END AS kept FROM p WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def mutual_exclusion(spark, folder):
    return folds.mutually_exclusive(src.assertions(spark, folder), "click", "view")


@register(
    "symmetric_dedup",
    """WITH e AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 's:' || l_suppkey ELSE 'p:' || l_partkey END AS subject, 'knows' AS rel_type,
            CASE WHEN l_linenumber % 2 = 0 THEN 'p:' || l_partkey ELSE 's:' || l_suppkey END AS object, l_discount AS confidence FROM lineitem)
    SELECT least(subject, object) AS low, greatest(subject, object) AS high, rel_type, count(*) AS n, max(confidence) AS confidence FROM e GROUP BY ALL""",
)
def symmetric_dedup(spark, folder):
    supplier, part = F.concat(F.lit("s:"), "l_suppkey"), F.concat(F.lit("p:"), "l_partkey")
    even = F.col("l_linenumber") % 2 == 0
    edges = src.table(spark, folder, "lineitem").select(F.when(even, supplier).otherwise(part).alias("subject"), F.lit("knows").alias("rel_type"), F.when(even, part).otherwise(supplier).alias("object"), F.col("l_discount").alias("confidence"))
    return folds.symmetric_dedup(edges)


@register(
    "inverse_completion",
    """WITH e AS (SELECT 's:' || l_suppkey AS subject, 'supplies' AS rel_type, 'p:' || l_partkey AS object, l_discount AS confidence FROM lineitem
            UNION ALL SELECT 'p:' || l_partkey, 'supplied_by', 's:' || l_suppkey, l_tax FROM lineitem WHERE l_linenumber = 1),
        w AS (SELECT * FROM e UNION ALL SELECT object, CASE rel_type WHEN 'supplies' THEN 'supplied_by' ELSE 'supplies' END, subject, confidence FROM e)
    SELECT subject, rel_type, object, max(confidence) AS confidence FROM w GROUP BY ALL""",
)
def inverse_completion(spark, folder):
    items = src.table(spark, folder, "lineitem")
    supplier, part = F.concat(F.lit("s:"), "l_suppkey"), F.concat(F.lit("p:"), "l_partkey")
    edges = items.select(supplier.alias("subject"), F.lit("supplies").alias("rel_type"), part.alias("object"), F.col("l_discount").alias("confidence"))
    edges = edges.unionByName(items.where("l_linenumber = 1").select(part.alias("subject"), F.lit("supplied_by").alias("rel_type"), supplier.alias("object"), F.col("l_tax").alias("confidence")))
    return folds.complete_inverses(edges, {"supplies": "supplied_by", "supplied_by": "supplies"})
