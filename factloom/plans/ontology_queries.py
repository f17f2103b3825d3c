"""Identities, overlays of ontologies, eligible groups and placement fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import identity, overlay, placement
from factloom.plans.registry import register
from factloom.sources import driver_tables as src


def _uuid_sql(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


def _customers(spark, folder):
    return src.table(spark, folder, "customer").withColumn("user_id", F.lower("c_mktsegment"))


@register(
    "identity_rewrite",
    f"""WITH c AS (
        SELECT lower(c_mktsegment) AS user_id, lower(c_name) AS name, c_nationkey, floor(c_acctbal / 500) AS step, CAST(c_acctbal AS DOUBLE) AS confidence FROM customer
    ), u AS (
        SELECT *, {_uuid_sql("user_id || ':' || name")} AS id, {_uuid_sql("user_id || ':' || 'nation ' || c_nationkey")} AS place FROM c
    ), m AS (
        SELECT *, min(id) OVER (PARTITION BY user_id, c_nationkey, step) AS one FROM u
    ) SELECT user_id, one AS subject_id, 'lives_in' AS rel_type, place AS object_id, max(confidence) AS confidence FROM m GROUP BY ALL""",
)
def identity_rewrite(spark, folder):
    """Customers of one segment, nation and step of balance are one entity."""
    rows = _customers(spark, folder).withColumn("step", F.floor(F.col("c_acctbal") / 500))
    facts = rows.select("user_id", F.col("c_name").alias("subject_id"), F.lit("lives_in").alias("rel_type"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("object_id"), F.col("c_acctbal").alias("confidence"))
    groups = rows.groupBy("user_id", "c_nationkey", "step").agg(F.min("c_name").alias("b"))
    links = rows.join(groups, ["user_id", "c_nationkey", "step"]).select("user_id", F.col("c_name").alias("a"), "b")
    return identity.rewritten({"facts": facts}, links)["facts"].select("user_id", "subject_id", "rel_type", "object_id", "confidence")


@register(
    "resolve_names",
    f"""WITH n AS (
        SELECT DISTINCT lower(c_mktsegment) AS user_id, name FROM (SELECT c_mktsegment, lower(trim(c_name)) AS name FROM customer UNION ALL SELECT c_mktsegment, 'nation ' || c_nationkey FROM customer UNION ALL SELECT c_mktsegment, 'me' FROM customer UNION ALL SELECT c_mktsegment, lower(o_orderpriority) FROM customer JOIN orders ON o_custkey = c_custkey)
    ), a AS (
        SELECT user_id, name, min(entity_id) AS entity_id FROM (SELECT lower(c_mktsegment) AS user_id, 'nation ' || c_nationkey AS name, {_uuid_sql("'n:' || lower(c_name)")} AS entity_id, c_acctbal > 0 AS preferred FROM customer WHERE c_acctbal > -500)
        GROUP BY user_id, name, preferred QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY preferred DESC) = 1
    ) SELECT n.user_id, n.name, CASE WHEN n.name = 'me' THEN {_uuid_sql("n.user_id || ':' || n.user_id")} WHEN a.entity_id IS NOT NULL THEN a.entity_id WHEN regexp_matches(n.name, '^[0-9]-') THEN NULL ELSE {_uuid_sql("n.user_id || ':' || n.name")} END AS entity_id,
        CASE WHEN n.name = 'me' THEN 'self' WHEN a.entity_id IS NOT NULL THEN 'alias' WHEN regexp_matches(n.name, '^[0-9]-') THEN 'relation' ELSE 'minted' END AS rung FROM n LEFT JOIN a ON a.user_id = n.user_id AND a.name = n.name""",
)
def resolve_names(spark, folder):
    """Names of customers, nations and order priorities, of which the nations have aliases and the priorities are relations."""
    rows = _customers(spark, folder)
    nation = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    orders = src.table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    names = rows.select("user_id", F.explode(F.array(F.col("c_name"), nation, F.lit(" Me "))).alias("name")).unionByName(rows.join(orders, "c_custkey").select("user_id", F.col("o_orderpriority").alias("name")))
    points = identity.uuid5(identity.NAMESPACE, F.concat(F.lit("n:"), F.lower("c_name")))
    aliases = rows.where("c_acctbal > -500").select("user_id", nation.alias("alias"), points.alias("entity_id"), (F.col("c_acctbal") > 0).alias("preferred"))
    entities = rows.select("user_id", F.col("c_name").alias("entity_id"))
    return identity.resolved(names, aliases, entities, orders.select(F.col("o_orderpriority").alias("rel_type")).distinct())


TENANTS = """o AS (
    SELECT c_nationkey AS tenant_id, lower(c_mktsegment) AS rel_type, min(c_name) AS label FROM customer WHERE c_acctbal > 9700 GROUP BY ALL
), g AS (
    SELECT s_nationkey AS tenant_id, 'supplies' AS rel_type, min(s_name) AS label FROM supplier GROUP BY ALL
), s AS (
    SELECT lower(p_brand) AS rel_type, min(p_name) AS label FROM part GROUP BY ALL
)"""


@register(
    "first_rung",
    f"""WITH {TENANTS}, t AS (SELECT n_nationkey AS tenant_id FROM nation UNION ALL SELECT NULL)
    SELECT tenant_id, 'overlay' AS rung, rel_type, label FROM o UNION ALL SELECT tenant_id, 'registry', rel_type, label FROM g WHERE tenant_id NOT IN (SELECT tenant_id FROM o)
    UNION ALL SELECT tenant_id, 'seed', rel_type, label FROM t, s WHERE tenant_id IS NULL OR (tenant_id NOT IN (SELECT tenant_id FROM o) AND tenant_id NOT IN (SELECT tenant_id FROM g))""",
)
def first_rung(spark, folder):
    """Nations as tenants: what their richest customers say, else their suppliers, else the brands of all parts."""
    read = lambda name: src.table(spark, folder, name)
    own = read("customer").where("c_acctbal > 9700").groupBy(F.col("c_nationkey").alias("tenant_id"), F.lower("c_mktsegment").alias("rel_type")).agg(F.min("c_name").alias("label"))
    registered = read("supplier").groupBy(F.col("s_nationkey").alias("tenant_id"), F.lit("supplies").alias("rel_type")).agg(F.min("s_name").alias("label"))
    seed = read("part").groupBy(F.lower("p_brand").alias("rel_type")).agg(F.min("p_name").alias("label"))
    tenants = read("nation").select(F.col("n_nationkey").alias("tenant_id")).unionByName(spark.range(1).select(F.lit(None).cast("int").alias("tenant_id")))
    return overlay.first_rung(tenants, own, registered, seed)


@register(
    "seed_copy",
    """WITH t AS (
        SELECT c_nationkey AS tenant_id, lower(c_mktsegment) AS rel_type, min(c_name) AS label, CAST(count(*) AS BIGINT) AS uses, CASE WHEN min(c_acctbal) < -900 THEN 'user_corrected' ELSE 'seeded' END AS source FROM customer WHERE c_acctbal < 6000 GROUP BY ALL
    ), s AS (
        SELECT lower(c_mktsegment) AS rel_type, max(c_name) AS label FROM customer GROUP BY ALL UNION ALL SELECT lower(o_orderpriority), max(o_orderstatus) FROM orders GROUP BY ALL
    ), n AS (
        SELECT n_nationkey AS tenant_id, s.* FROM nation, s
    ) SELECT t.tenant_id, t.rel_type, CASE WHEN source = 'user_corrected' OR n.label IS NULL THEN t.label ELSE n.label END AS label, uses, source FROM t LEFT JOIN n ON n.tenant_id = t.tenant_id AND n.rel_type = t.rel_type
    UNION ALL SELECT n.tenant_id, n.rel_type, n.label, NULL, 'seeded' FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.tenant_id = n.tenant_id AND t.rel_type = n.rel_type)""",
)
def seed_copy(spark, folder):
    """Relations of nations after a copy of the seed: corrected ones stay, others take its label, missing ones come in."""
    customers, orders = src.table(spark, folder, "customer"), src.table(spark, folder, "orders")
    source = F.when(F.min("c_acctbal") < -900, "user_corrected").otherwise("seeded")
    tenant = customers.where("c_acctbal < 6000").groupBy(F.col("c_nationkey").alias("tenant_id"), F.lower("c_mktsegment").alias("rel_type")).agg(F.min("c_name").alias("label"), F.count("*").alias("uses"), source.alias("source"))
    seed = customers.groupBy(F.lower("c_mktsegment").alias("rel_type")).agg(F.max("c_name").alias("label")).unionByName(orders.groupBy(F.lower("o_orderpriority").alias("rel_type")).agg(F.max("o_orderstatus").alias("label")))
    tenants = src.table(spark, folder, "nation").select(F.col("n_nationkey").alias("tenant_id"))
    return overlay.seeded(tenant, seed.withColumn("source", F.lit("seeded")), tenants, ["rel_type"], ["label"])


@register(
    "eligible_groups",
    """WITH k AS (
        SELECT lower(p_brand) AS rel_type, count(*) % 2 = 0 AS is_hierarchy_rel, CASE WHEN min(p_size) = 1 THEN 'P31' END AS wikidata_pid, list(DISTINCT p_type) FILTER (p_size = 50) AS heads, list(DISTINCT p_type) FILTER (p_size = 2) AS tails FROM part GROUP BY ALL
    ), b AS (
        SELECT list(rel_type ORDER BY rel_type DESC) AS rels FROM k
    ), t AS (
        SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN ['ANY'] WHEN n_nationkey % 7 = 0 THEN [] ELSE (SELECT list(DISTINCT upper(p_type) ORDER BY upper(p_type)) FROM part WHERE p_size % (n_nationkey % 6 + 2) = 0) END AS members, list_concat(rels, ['Novel_Rel']) AS rels FROM nation, b
    ), e AS (
        SELECT n_name, list_transform(members, lambda m: lower(m)) AS ms, generate_subscripts(rels, 1) AS i, unnest(rels) AS rel FROM t
    ), j AS (
        SELECT e.*, k.rel_type IS NULL OR len(ms) = 0 OR NOT (is_hierarchy_rel AND coalesce(wikidata_pid, '') = 'P31' OR NOT list_contains(ms, 'any') AND (NOT list_has_all(ms, list_transform(coalesce(heads, []), lambda h: lower(h))) OR NOT list_has_all(ms, list_transform(coalesce(tails, []), lambda h: lower(h))))) AS stays
        FROM e LEFT JOIN k ON k.rel_type = lower(rel)
    ) SELECT n_name AS taxonomy_name, coalesce(string_agg(rel, ',' ORDER BY i) FILTER (stays), '') AS defining FROM j GROUP BY n_name""",
)
def eligible_groups(spark, folder):
    """Taxonomies of nations whose defining relations are brands, judged by the types of the parts."""
    part = src.table(spark, folder, "part")
    kinds = lambda size: F.collect_set(F.when(F.col("p_size") == size, F.col("p_type")))
    relations = part.groupBy(F.lower("p_brand").alias("rel_type")).agg((F.count("*") % 2 == 0).alias("is_hierarchy_rel"), F.when(F.min("p_size") == 1, "P31").alias("wikidata_pid"), kinds(50).alias("head_types"), kinds(2).alias("tail_types"))
    rels = relations.agg(F.concat(F.sort_array(F.collect_list("rel_type"), asc=False), F.array(F.lit("Novel_Rel"))).alias("defining_rels"))
    kinds_of = part.select("p_size", F.upper("p_type").alias("kind")).distinct()
    steps = spark.range(6).select(F.col("id").cast("int").alias("step")).join(kinds_of, F.expr("p_size % (step + 2) = 0")).groupBy("step").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    nations = src.table(spark, folder, "nation").select("n_name", "n_nationkey", (F.col("n_nationkey") % 6).alias("step")).join(steps, "step", "left").join(rels)
    members = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("ANY"))).when(F.col("n_nationkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.coalesce("kinds", F.array().cast("array<string>")))
    found = overlay.eligible_groups(nations.select(F.col("n_name").alias("taxonomy_name"), members.alias("members"), "defining_rels"), relations)
    return found.select("taxonomy_name", F.array_join("defining_rels", ",").alias("defining"))


@register(
    "placement_fingerprints",
    """WITH l AS (
        SELECT user_id AS entity_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS sign, md5('saw' || chr(31) || (props ->> '$.k')) AS h FROM events
    ), s AS (
        SELECT entity_id, CAST(sum(sign) AS BIGINT) AS n, ((sum(sign * CAST('0x' || substr(h, 1, 8) AS BIGINT)) % 4294967296) + 4294967296) % 4294967296 AS low, ((sum(sign * CAST('0x' || substr(h, 9, 8) AS BIGINT)) % 4294967296) + 4294967296) % 4294967296 AS high FROM l GROUP BY entity_id
    ) SELECT entity_id, n, n || '-' || lpad(lower(to_hex(CAST(low AS BIGINT))), 8, '0') || lpad(lower(to_hex(CAST(high AS BIGINT))), 8, '0') AS fingerprint FROM s WHERE n <> 0 OR low <> 0 OR high <> 0""",
)
def placement_fingerprints(spark, folder):
    """What each user saw, an error taking a sighting away, from the sums of three parts of the log."""
    events = src.table(spark, folder, "events")
    log = events.select(F.col("user_id").alias("entity_id"), F.lit("saw").alias("rel_type"), F.get_json_object("props", "$.k").alias("object"), (F.col("event_type") != "error").alias("live"), F.dayofmonth("ts").alias("day"))
    return placement.fingerprints(placement.added(*[placement.edge_sums(log.where(F.col("day") % 3 == i)) for i in range(3)]))
