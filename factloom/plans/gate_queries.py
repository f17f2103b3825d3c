"""The write gate over the graph of the driver tables, and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import gate, ranking
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

PLAIN = f"""{src.HIERARCHY}, {src.RELATIONS}, {src.ENTITY_TYPES}, {src.REL_TYPES}, {src.ASSERTIONS}, edges AS (
    SELECT subject || '|' || rel_type || '|' || object AS id, subject, rel_type, object, [0.0, 0.5, 0.92, 0.96, 1.0][length(subject) % 5 + 1] AS confidence,
        CASE WHEN length(object) % 2 = 0 THEN 'user_stated' ELSE 'llm_inferred' END AS provenance, length(object) % 7 = 0 AS is_correction
    FROM (SELECT * FROM hierarchy UNION ALL SELECT * FROM relations UNION ALL SELECT subject, rel_type, object FROM assertions)
)"""
TYPED = f"""{PLAIN}, known AS (SELECT * FROM entity_types WHERE lower(entity_type) <> 'unknown'),
    up(start, node, depth) AS (SELECT entity_id, entity_id, 0 FROM entity_types UNION ALL SELECT up.start, h.object, up.depth + 1 FROM up JOIN hierarchy h ON h.subject = up.node WHERE up.depth < 4),
    near AS (SELECT start, arg_min(entity_type, (depth, node)) AS kind FROM up JOIN known ON entity_id = node GROUP BY start),
    typed AS (SELECT e.*, r.head_types, r.tail_types, h.entity_type AS head0, t.entity_type AS tail0, coalesce(h.entity_type, hw.kind) AS head, coalesce(t.entity_type, tw.kind) AS tail
        FROM edges e LEFT JOIN rel_types r USING (rel_type) LEFT JOIN known h ON h.entity_id = e.subject LEFT JOIN known t ON t.entity_id = e.object LEFT JOIN near hw ON hw.start = e.subject LEFT JOIN near tw ON tw.start = e.object),
    fits AS (SELECT *, head_types IS NULL OR head_types = ['ANY'] AS any_head, tail_types IS NULL OR tail_types = ['ANY'] AS any_tail,
        list_contains(list_transform(head_types, lambda x: lower(x)), lower(head)) OR list_contains(head_types, 'ANY') AS head_in, list_contains(list_transform(tail_types, lambda x: lower(x)), lower(tail)) OR list_contains(tail_types, 'ANY') AS tail_in FROM typed),
    reasoned AS (SELECT *, CASE
        WHEN any_head AND any_tail THEN 'unconstrained'
        WHEN tail_types = ['SCALAR'] THEN CASE WHEN any_head OR head_in THEN 'valid' WHEN head IS NULL THEN 'type_unknown' ELSE 'type_mismatch' END
        WHEN head IS NULL THEN 'type_unknown' WHEN head0 IS NULL AND NOT (any_head OR head_in) THEN 'hierarchy_type_mismatch'
        WHEN tail IS NULL THEN 'type_unknown' WHEN tail0 IS NULL AND NOT (any_tail OR tail_in) THEN 'hierarchy_type_mismatch'
        WHEN (any_head OR head_in) AND (any_tail OR tail_in) THEN 'valid' ELSE 'type_mismatch' END AS reason FROM fits)"""


def edges(spark, folder):
    triples = ["subject", "rel_type", "object"]
    every = src.hierarchy(spark, folder).unionByName(src.relations(spark, folder)).unionByName(src.assertions(spark, folder).select(*triples))
    return every.select(
        *triples,
        F.get(F.array(*[F.lit(c) for c in (0.0, 0.5, 0.92, 0.96, 1.0)]), F.length("subject") % 5).alias("confidence"),
        F.when(F.length("object") % 2 == 0, F.lit("user_stated")).otherwise(F.lit("llm_inferred")).alias("provenance"),
        (F.length("object") % 7 == 0).alias("is_correction"),
    )


def typed(spark, folder):
    return gate.typed(edges(spark, folder).select("subject", "rel_type", "object"), src.entity_types(spark, folder), src.rel_types(spark), src.hierarchy(spark, folder))


@register("type_constraint_check", f"WITH RECURSIVE {TYPED} SELECT subject, rel_type, object, reason FROM reasoned")
def type_constraint_check(spark, folder):
    return typed(spark, folder).select("subject", "rel_type", "object", gate.type_reason().alias("reason"))


@register(
    "infer_entity_types",
    f"""WITH RECURSIVE {TYPED}, i AS (SELECT subject AS entity_id, head_types[1] AS entity_type FROM typed WHERE head IS NULL AND head_types[1] NOT IN ('ANY', 'SCALAR')
        UNION ALL SELECT object, tail_types[1] FROM typed WHERE tail IS NULL AND tail_types[1] NOT IN ('ANY', 'SCALAR')) SELECT entity_id, min(entity_type) AS entity_type FROM i GROUP BY 1""",
)
def infer_entity_types(spark, folder):
    """Types for ends that have none, stored or inherited: the first that their relation allows."""
    return gate.inferred_types(typed(spark, folder))


@register(
    "gate_status_pipeline",
    f"""WITH RECURSIVE {TYPED}, o AS (SELECT subject, rel_type, count(DISTINCT object) AS objects FROM edges GROUP BY ALL),
        s AS (SELECT r.*, CASE WHEN head_types IS NULL AND confidence < 0.9 THEN 'novel_unapproved'
            WHEN confidence >= 0.95 AND reason IN ('type_mismatch', 'hierarchy_type_mismatch') AND provenance <> 'user_stated' AND NOT is_correction THEN 'valid_staged'
            WHEN confidence >= 0.95 OR (is_correction AND confidence >= 0.9) THEN 'valid' WHEN reason = 'type_mismatch' THEN 'type_mismatch'
            WHEN reason = 'hierarchy_type_mismatch' THEN CASE WHEN provenance = 'user_stated' OR is_correction THEN 'valid' ELSE 'hierarchy_flagged' END
            WHEN objects > 1 THEN 'conflict' ELSE 'valid' END AS status FROM reasoned r JOIN o USING (subject, rel_type))
    SELECT id, subject, rel_type, object, reason, status,
        CASE WHEN status = 'valid_staged' THEN 'C' WHEN provenance = 'user_stated' THEN 'A' WHEN confidence >= 0.6 THEN 'B' ELSE 'C' END AS fact_class FROM s""",
)
def gate_status_pipeline(spark, folder):
    found = gate.gate(edges(spark, folder), src.entity_types(spark, folder), src.rel_types(spark), src.hierarchy(spark, folder))
    return found.select(F.concat_ws("|", "subject", "rel_type", "object").alias("id"), *found.columns)


@register("cross_type_guard", f"WITH {src.REL_TYPES} SELECT rel_type, len(list_filter(head_types, lambda x: x NOT IN ('ANY', 'SCALAR'))) > 0 AND len(list_filter(tail_types, lambda x: x NOT IN ('ANY', 'SCALAR'))) > 0 AND NOT list_has_any(list_filter(head_types, lambda x: x NOT IN ('ANY', 'SCALAR')), list_filter(tail_types, lambda x: x NOT IN ('ANY', 'SCALAR'))) AS cross_type FROM rel_types")
def cross_type_guard(spark, folder):
    return src.rel_types(spark).select("rel_type", gate.cross_type().alias("cross_type"))


@register(
    "confidence_route",
    f"WITH {src.ASSERTIONS} SELECT CASE WHEN provenance = 'user_stated' THEN 'A' WHEN confidence >= 0.6 THEN 'B' ELSE 'C' END AS route, rel_type, count(*) AS n FROM assertions GROUP BY ALL",
)
def confidence_route(spark, folder):
    routed = src.assertions(spark, folder).withColumn("route", gate.route(F.col("confidence"), F.col("provenance")))
    return routed.groupBy("route", "rel_type").agg(F.count("*").alias("n"))


@register(
    "unified_confidence",
    """SELECT event_id AS id, round(CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN least(1.0, 0.6 * (CAST(event_id % 11 AS DOUBLE) / 10))
        ELSE greatest(0.0, least(1.0, 0.5 * least(1.0, CAST(event_id % 7 AS DOUBLE) / greatest(3.0, 1.0)) + 0.5 * (CAST(event_id % 11 AS DOUBLE) / 10))) END, 6) AS unified FROM events""",
)
def unified_confidence(spark, folder):
    source = F.element_at(F.array(F.lit("user"), F.lit("engine"), F.lit("llm")), (F.col("event_id") % 3 + 1).cast("int"))
    value = gate.unified_confidence(source, (F.col("event_id") % 11).cast("double") / 10, (F.col("event_id") % 7).cast("double"), F.lit(3.0))
    return src.table(spark, folder, "events").select(F.col("event_id").alias("id"), F.round(value, 6).alias("unified"))


@register(
    "edge_shape_check",
    "SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'subject' WHEN event_id % 17 = 0 THEN 'object' WHEN event_id % 19 = 0 THEN 'rel_type' END AS missing FROM events",
)
def edge_shape_check(spark, folder):
    blank = lambda n, value: F.when(F.col("event_id") % n == 0, F.lit(" ")).otherwise(value)
    rows = src.table(spark, folder, "events").select(F.col("event_id").alias("id"), blank(13, F.lit("s")).alias("subject"), blank(17, F.lit("o")).alias("object"), blank(19, F.col("event_type")).alias("rel_type"))
    return gate.shape_error(rows).select("id", "missing")


COSINE = "round(CAST(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS DOUBLE), 6)"


@register("cosine_topk", f"SELECT v.vec_id, {COSINE.format(a='v.embedding', b='q.embedding')} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, folder):
    vectors = src.table(spark, folder, "embeddings")
    return ranking.top_cosine(vectors, vectors.where("vec_id = 0"), 20)


@register(
    "rrf_fuse",
    f"""WITH a AS (SELECT v.vec_id, {COSINE.format(a='v.embedding', b='q.embedding')} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20),
        b AS (SELECT v.vec_id, {COSINE.format(a='v.embedding', b='q.embedding')} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY score DESC, vec_id LIMIT 20),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS place FROM a UNION ALL SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) - 1 FROM b)
    SELECT vec_id, round(sum(1.0::DOUBLE / (60 + place)), 6) AS fused, max(score) AS best FROM r GROUP BY vec_id""",
)
def rrf_fuse(spark, folder):
    vectors = src.table(spark, folder, "embeddings")
    return ranking.fuse([ranking.top_cosine(vectors, vectors.where(f"vec_id = {i}"), 20) for i in (0, 1)])


@register(
    "inject_gate",
    f"""WITH {src.ASSERTIONS}, s AS (SELECT subject, bool_or(fact_class IN ('B', 'C') AND confidence >= 0.7) AS any_passes FROM assertions GROUP BY 1)
    SELECT id, subject, fact_class, confidence FROM assertions JOIN s USING (subject) WHERE fact_class = 'A' OR (fact_class IN ('B', 'C') AND confidence >= 0.7) OR NOT any_passes""",
)
def inject_gate(spark, folder):
    return ranking.inject(src.assertions(spark, folder).select("id", "subject", "fact_class", "confidence"), "subject", 0.7)
