"""Walks and lookups over the graph of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graphs, rendering
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

UP = """up(start, node, depth) AS (
    SELECT entity_id, entity_id, 0 FROM entity_types
    UNION ALL SELECT up.start, h.object, up.depth + 1 FROM up JOIN hierarchy h ON h.subject = up.node WHERE up.depth < 4
)"""

TAXONOMIES = """taxonomies AS (SELECT * FROM (VALUES
    ('place', ['Location', 'Region'], ['located_in']), ('business', ['Organization', 'Location'], ['located_in', 'supplies']), ('goods', ['Object'], ['supplies'])
) AS t(taxonomy, members, defining_rels))"""


def taxonomies(spark):
    rows = [("place", ["Location", "Region"], ["located_in"]), ("business", ["Organization", "Location"], ["located_in", "supplies"]), ("goods", ["Object"], ["supplies"])]
    return spark.createDataFrame(rows, "taxonomy string, members array<string>, defining_rels array<string>")


def customers(spark, folder):
    return src.table(spark, folder, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("entity_id"))


@register(
    "flagship_live_fact_view",
    f"""WITH RECURSIVE {src.HIERARCHY}, {src.ENTITY_TYPES}, {UP}, {src.ATTRIBUTES},
        r AS (SELECT start, node FROM up WHERE node LIKE 'region:%' AND start LIKE 'customer:%')
    SELECT r.start AS entity_id, n.r_name AS region, a.value_float AS balance, r.start || ' is in ' || n.r_name AS text
    FROM r JOIN region n ON 'region:' || n.r_regionkey = r.node JOIN attributes a ON a.entity_id = r.start AND a.attribute = 'account_balance' WHERE a.value_float > 0""",
)
def flagship_live_fact_view(spark, folder):
    """Which region each customer in credit is in, by walking up, and the sentence that says so."""
    walked = graphs.walk_up(src.hierarchy(spark, folder), customers(spark, folder)).where("node like 'region:%'")
    names = src.table(spark, folder, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"), F.col("r_name").alias("region"))
    balance = src.attributes(spark, folder).where("attribute = 'account_balance' and value_float > 0").select("entity_id", F.col("value_float").alias("balance"))
    rows = walked.join(names, "node").withColumnRenamed("start", "entity_id").join(balance, "entity_id")
    text = rendering.sentence(F.lit("{x} is in {y}"), F.lit("located_in"), F.col("entity_id"), F.col("region"))
    return rows.select("entity_id", "region", "balance", text.alias("text"))


@register(
    "walk_up_nearest_type",
    f"""WITH RECURSIVE {src.HIERARCHY}, {src.ENTITY_TYPES}, {UP}
    SELECT start, arg_min(entity_type, (depth, node)) AS entity_type, CAST(min(depth) AS BIGINT) AS depth FROM up JOIN entity_types t ON t.entity_id = up.node WHERE entity_type <> 'unknown' GROUP BY start""",
)
def walk_up_nearest_type(spark, folder):
    types = src.entity_types(spark, folder)
    return graphs.nearest_type(src.hierarchy(spark, folder), types, types.select("entity_id"))


@register(
    "walk_down_members",
    f"""WITH RECURSIVE {src.HIERARCHY}, d(root, node, depth) AS (
        SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region
        UNION ALL SELECT d.root, h.subject, d.depth + 1 FROM d JOIN hierarchy h ON h.object = d.node)
    SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM d WHERE depth > 0 GROUP BY ALL""",
)
def walk_down_members(spark, folder):
    roots = src.table(spark, folder, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("entity_id"))
    return graphs.members_below(src.hierarchy(spark, folder), roots).withColumn("depth", F.col("depth").cast("long"))


@register(
    "one_hop_both_sides",
    f"""WITH {src.HIERARCHY}, a AS (SELECT 'nation:' || n_nationkey AS entity_id FROM nation)
    SELECT subject, rel_type, object, 'subject' AS side FROM hierarchy WHERE subject IN (SELECT entity_id FROM a)
    UNION ALL SELECT subject, rel_type, object, 'object' FROM hierarchy WHERE object IN (SELECT entity_id FROM a)""",
)
def one_hop_both_sides(spark, folder):
    anchors = src.table(spark, folder, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id"))
    return graphs.one_hop(src.hierarchy(spark, folder), anchors)


@register(
    "identity_closure",
    """WITH s AS (SELECT 'customer:' || c_custkey AS subject, 'customer:' || (c_custkey * 7 % 1000) AS object FROM customer),
        u AS (SELECT 'customer:' || c_custkey AS me FROM customer)
    SELECT me AS user, me AS member FROM u UNION SELECT me, object FROM u JOIN s ON me = subject UNION SELECT me, subject FROM u JOIN s ON me = object""",
)
def identity_closure(spark, folder):
    customer = src.table(spark, folder, "customer")
    same_as = customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("subject"), F.expr("concat('customer:', c_custkey * 7 % 1000)").alias("object"))
    return graphs.identity_set(same_as, customers(spark, folder))


@register(
    "taxonomy_bridge_join",
    f"""WITH {src.HIERARCHY}, {src.RELATIONS}, {TAXONOMIES}, e AS (SELECT * FROM hierarchy UNION ALL SELECT * FROM relations),
        b AS (SELECT taxonomy, unnest(defining_rels) AS rel_type FROM taxonomies)
    SELECT taxonomy, rel_type, count(*) AS n FROM e JOIN b USING (rel_type) GROUP BY ALL""",
)
def taxonomy_bridge_join(spark, folder):
    return graphs.taxonomy_bridge(taxonomies(spark), src.hierarchy(spark, folder).unionByName(src.relations(spark, folder)))


@register(
    "membership_check",
    f"""WITH {src.HIERARCHY}, {src.RELATIONS}, {src.ENTITY_TYPES}, {TAXONOMIES}, e AS (SELECT * FROM hierarchy UNION ALL SELECT * FROM relations),
        x AS (SELECT e.*, h.entity_type AS head, t.entity_type AS tail FROM e JOIN entity_types h ON h.entity_id = subject JOIN entity_types t ON t.entity_id = object),
        m AS (SELECT x.subject, x.rel_type, x.object, coalesce(max(CAST(list_contains(k.members, head) AS INT) + CAST(list_contains(k.members, tail) AS INT)), 0) AS sides
            FROM x LEFT JOIN taxonomies k ON list_contains(k.defining_rels, x.rel_type) GROUP BY ALL)
    SELECT subject, rel_type, object, CASE sides WHEN 2 THEN 'ok' WHEN 1 THEN 'violation' ELSE 'unconstrained' END AS status FROM m""",
)
def membership_check(spark, folder):
    return graphs.membership(src.hierarchy(spark, folder).unionByName(src.relations(spark, folder)), src.entity_types(spark, folder), taxonomies(spark))


@register(
    "concept_parent_fallback",
    f"""WITH {src.HIERARCHY}, f AS (SELECT 'nation:' || n_nationkey AS subject, 'named' AS rel_type, n_name AS object FROM nation WHERE n_nationkey % 2 = 0),
        c AS (SELECT 'customer:' || c_custkey AS entity_id FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation)
    SELECT entity_id, rel_type, object, 'own' AS via FROM c JOIN f ON f.subject = entity_id
    UNION ALL SELECT entity_id, f.rel_type, f.object, 'parent' FROM c JOIN hierarchy h ON h.subject = entity_id JOIN f ON f.subject = h.object WHERE entity_id NOT IN (SELECT subject FROM f)""",
)
def concept_parent_fallback(spark, folder):
    nation = src.table(spark, folder, "nation")
    named = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation:"), "n_nationkey").alias("subject"), F.lit("named").alias("rel_type"), F.col("n_name").alias("object"))
    concepts = customers(spark, folder).unionByName(nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id")))
    return graphs.own_or_parent_facts(concepts, named, src.hierarchy(spark, folder))


@register(
    "retract_target_priority",
    f"""WITH {src.ASSERTIONS}, f AS (SELECT * FROM assertions WHERE fact_class = 'A'), s AS (SELECT * FROM assertions WHERE fact_class <> 'A'),
        w AS (SELECT DISTINCT subject AS entity_id, 'k:7' AS wanted FROM assertions UNION SELECT DISTINCT object, 'none' FROM assertions),
        e AS (SELECT entity_id, id, 1 AS rung FROM w JOIN f ON entity_id = subject AND wanted = object
            UNION ALL SELECT entity_id, id, 2 FROM w JOIN f ON entity_id = object
            UNION ALL SELECT entity_id, id, 3 FROM w JOIN s ON entity_id = subject OR entity_id = object)
    SELECT entity_id, CAST(rung AS BIGINT) AS rung, id FROM e QUALIFY rung = min(rung) OVER (PARTITION BY entity_id)""",
)
def retract_target_priority(spark, folder):
    log = src.assertions(spark, folder)
    wanted = log.select(F.col("subject").alias("entity_id"), F.lit("k:7").alias("wanted")).unionByName(log.select(F.col("object").alias("entity_id"), F.lit("none").alias("wanted"))).distinct()
    return graphs.retract_targets(wanted, log.where("fact_class = 'A'"), log.where("fact_class <> 'A'"))


@register(
    "canonical_ladder",
    f"""WITH {src.ASSERTIONS}
    SELECT CASE WHEN rel_type = 'purchase' THEN object ELSE subject END AS subject,
        CASE rel_type WHEN 'view' THEN 'view' WHEN 'error' THEN 'error' WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'bought_by' END AS rel_type,
        CASE WHEN rel_type = 'purchase' THEN subject ELSE object END AS object,
        CASE WHEN rel_type IN ('view', 'error') THEN 'exact' WHEN rel_type IN ('click', 'purchase') THEN 'alias' ELSE 'none' END AS rung FROM assertions""",
)
def canonical_ladder(spark, folder):
    known = src.rel_types(spark).select("rel_type")
    aliases = spark.createDataFrame([("click", "view", False), ("purchase", "bought_by", True)], "alias string, canonical string, requires_inversion boolean")
    return graphs.canonical_ladder(src.assertions(spark, folder), known, aliases)


@register(
    "attribute_unpivot",
    f"WITH {src.ATTRIBUTES} SELECT entity_id, attribute, value_text, value_float FROM attributes",
)
def attribute_unpivot(spark, folder):
    return src.attributes(spark, folder)
