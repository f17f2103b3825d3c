"""Facts and staged facts of the driver's events: live views, retractions and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import store
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

NOW = "2024-02-20 00:00:00"

TABLES = f"""{src.ASSERTIONS}, facts AS (SELECT id, subject, rel_type, object, confidence, fact_class, CASE WHEN id % 6 = 0 THEN ts + INTERVAL 5 DAY END AS superseded_at,
        CASE WHEN id % 15 = 1 THEN ts + INTERVAL 7 DAY END AS archived_at, CASE WHEN id % 15 = 1 THEN ts + INTERVAL 7 DAY END AS deleted_at, ts FROM assertions WHERE fact_class <> 'C'),
    staged_facts AS (SELECT id, subject, rel_type, object, confidence, fact_class, CASE WHEN id % 4 = 0 THEN ts + INTERVAL 3 DAY END AS promoted_at, CASE WHEN id % 9 = 0 THEN ts + INTERVAL 4 DAY END AS deleted_at, ts FROM assertions WHERE fact_class = 'C')"""
REQUESTS = """requests AS (SELECT DISTINCT subject AS request, subject, CASE WHEN length(subject) % 2 = 0 THEN 'Purchase' END AS rel_type, CAST(NULL AS VARCHAR) AS old_value FROM assertions
    UNION ALL SELECT DISTINCT object, object, 'view', NULL FROM assertions UNION ALL SELECT DISTINCT subject || '/' || object, subject, NULL, object FROM assertions)"""


def facts(spark, folder):
    after = lambda rule, days: F.when(F.expr(rule), F.col("ts") + F.make_dt_interval(F.lit(days)))
    rows = src.assertions(spark, folder).where("fact_class <> 'C'").select("id", "subject", "rel_type", "object", "confidence", "fact_class", "ts")
    return rows.withColumns({"superseded_at": after("id % 6 = 0", 5), "archived_at": after("id % 15 = 1", 7), "deleted_at": after("id % 15 = 1", 7)})


def staged_facts(spark, folder):
    after = lambda rule, days: F.when(F.expr(rule), F.col("ts") + F.make_dt_interval(F.lit(days)))
    rows = src.assertions(spark, folder).where("fact_class = 'C'").select("id", "subject", "rel_type", "object", "confidence", "fact_class", "ts")
    return rows.withColumns({"promoted_at": after("id % 4 = 0", 3), "deleted_at": after("id % 9 = 0", 4)})


def requests(spark, folder):
    log = src.assertions(spark, folder)
    none = F.lit(None).cast("string")
    whole = log.select(F.col("subject").alias("request"), "subject", F.when(F.length("subject") % 2 == 0, F.lit("Purchase")).alias("rel_type"), none.alias("old_value")).distinct()
    turned = log.select(F.col("object").alias("request"), F.col("object").alias("subject"), F.lit("view").alias("rel_type"), none.alias("old_value")).distinct()
    narrow = log.select(F.concat_ws("/", "subject", "object").alias("request"), "subject", none.alias("rel_type"), F.col("object").alias("old_value")).distinct()
    return whole.unionByName(turned).unionByName(narrow)


@register(
    "live_facts_and_staged",
    f"""WITH {TABLES} SELECT id, subject, rel_type, object, confidence, fact_class, 'facts' AS source_table FROM facts WHERE superseded_at IS NULL AND deleted_at IS NULL
    UNION ALL SELECT id, subject, rel_type, object, confidence, fact_class, 'staged_facts' FROM staged_facts WHERE promoted_at IS NULL AND deleted_at IS NULL""",
)
def live_facts_and_staged(spark, folder):
    return store.live(facts(spark, folder), staged_facts(spark, folder))


@register(
    "default_and_history_reads",
    f"WITH {TABLES} SELECT subject, count(*) FILTER (archived_at IS NULL) AS shown, count(*) AS in_history FROM facts GROUP BY subject",
)
def default_and_history_reads(spark, folder):
    """How many facts of each subject a default read shows, and how many its history holds."""
    rows = facts(spark, folder)
    shown = store.readable(rows).groupBy("subject").agg(F.count("*").alias("shown"))
    return store.readable(rows, history=True).groupBy("subject").agg(F.count("*").alias("in_history")).join(shown, "subject", "left").select("subject", F.coalesce("shown", F.lit(0)).alias("shown"), "in_history")


def _targets_sql(mode: str) -> str:
    gone = "deleted_at IS NOT NULL"
    lf, ls = (gone, gone) if mode == "unforget" else ("superseded_at IS NULL AND deleted_at IS NULL", "promoted_at IS NULL AND deleted_at IS NULL")
    rule = "(r.rel_type IS NULL OR lower(r.rel_type) = f.rel_type)"
    held = "(r.old_value IS NULL OR r.old_value = f.object)"
    only = "" if mode in ("hard_delete", "unforget") else "WHERE request NOT IN (SELECT request FROM b)"
    return f"""WITH {TABLES}, {REQUESTS}, m AS (
        SELECT request, f.id, 0 AS rank FROM requests r JOIN facts f ON r.subject = f.subject AND {rule} AND {held} WHERE {lf}
        UNION ALL SELECT request, f.id, 1 FROM requests r JOIN facts f ON r.subject = f.object AND {rule} WHERE {lf}),
        b AS (SELECT request, min(rank) AS rank FROM m GROUP BY 1),
        s AS (SELECT DISTINCT request, f.id FROM requests r JOIN staged_facts f ON (r.subject = f.subject OR r.subject = f.object) AND {rule} AND {held} WHERE {ls}),
        u AS (SELECT request, id, 'facts' AS source_table FROM m JOIN b USING (request, rank) UNION ALL SELECT request, id, 'staged_facts' FROM s {only})
    SELECT request, id, source_table, CASE WHEN count(DISTINCT source_table) OVER (PARTITION BY request) > 1 THEN 'both' ELSE source_table END AS label FROM u"""


def _targets(mode: str):
    def query(spark, folder):
        return store.retraction_targets(requests(spark, folder), facts(spark, folder), staged_facts(spark, folder), mode)

    return query


for _name, _mode in (("retract_supersede", "supersede"), ("retract_forget", "hard_delete"), ("retract_unforget", "unforget")):
    register(_name, _targets_sql(_mode))(_targets(_mode))


@register(
    "apply_retraction",
    f"WITH {TABLES} SELECT id, superseded_at, CASE WHEN rel_type = 'error' THEN TIMESTAMP '{NOW}' ELSE archived_at END AS archived_at, CASE WHEN rel_type = 'error' THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at FROM facts",
)
def apply_retraction(spark, folder):
    rows = facts(spark, folder)
    return store.retracted(rows, rows.where("rel_type = 'error'"), "hard_delete", NOW).select("id", "superseded_at", "archived_at", "deleted_at")


BEHAVIOURS = "behaviours AS (SELECT * FROM (VALUES ('purchase', 'immutable'), ('view', 'hard_delete'), ('error', 'odd')) t(rel_type, correction_behavior))"


@register(
    "correction_actions",
    f"""WITH {src.ASSERTIONS}, {BEHAVIOURS} SELECT id, CASE WHEN id % 3 <> 0 THEN 'accept' WHEN coalesce(correction_behavior, 'supersede') IN ('hard_delete', 'supersede', 'immutable') THEN coalesce(correction_behavior, 'supersede') ELSE 'accept' END AS action
    FROM assertions LEFT JOIN behaviours USING (rel_type)""",
)
def correction_actions(spark, folder):
    rows = src.assertions(spark, folder).withColumn("is_correction", F.col("id") % 3 == 0)
    behaviours = spark.createDataFrame([("purchase", "immutable"), ("view", "hard_delete"), ("error", "odd")], "rel_type string, correction_behavior string")
    return store.correction_action(rows, behaviours).select("id", "action")


PAIRS = "pairs AS (SELECT * FROM (VALUES ('error', 'view'), ('error', 'click'), ('signup', 'purchase')) t(rel_type, against))"


@register(
    "archive_contradicted",
    f"""WITH {TABLES}, {PAIRS} SELECT DISTINCT f.id, f.subject, f.rel_type FROM facts f JOIN pairs p ON p.against = f.rel_type JOIN assertions c ON c.rel_type = p.rel_type AND c.subject = f.subject AND c.provenance = 'user_stated' WHERE f.archived_at IS NULL""",
)
def archive_contradicted(spark, folder):
    """Facts that a user's later word of a contradicting relation archives; the pairs are the driver's event types."""
    corrections = src.assertions(spark, folder).where("provenance = 'user_stated'")
    pairs = [("error", "view"), ("error", "click"), ("signup", "purchase")]
    return store.archive_contradicted(facts(spark, folder), corrections, pairs).select("id", "subject", "rel_type")


@register(
    "drop_staged_conflicts",
    f"""WITH {TABLES}, c AS (SELECT DISTINCT subject, rel_type, object FROM assertions WHERE provenance = 'user_stated') SELECT id FROM staged_facts s
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.subject = s.subject AND c.rel_type = s.rel_type) OR EXISTS (SELECT 1 FROM c WHERE c.subject = s.subject AND c.rel_type = s.rel_type AND c.object = s.object)""",
)
def drop_staged_conflicts(spark, folder):
    return store.drop_staged_conflicts(staged_facts(spark, folder), src.assertions(spark, folder).where("provenance = 'user_stated'")).select("id")


@register(
    "conflict_insert",
    f"""WITH {src.ASSERTIONS}, l AS (SELECT *, ['now', 'past', 'future', 'odd'][id % 4 + 1] AS temporal_status, CASE WHEN id % 3 = 0 THEN CAST(ts AS DATE) END AS event_date, CASE WHEN id % 5 = 0 THEN 'negated' END AS polarity FROM assertions)
    SELECT subject, rel_type, object, coalesce(arg_max(temporal_status, (ts, id)) FILTER (temporal_status IN ('past', 'future')), 'now') AS temporal_status,
        arg_max(event_date, (ts, id)) FILTER (event_date IS NOT NULL) AS event_date, arg_max(coalesce(polarity, 'affirmed'), (ts, id)) AS polarity FROM l GROUP BY ALL""",
)
def conflict_insert(spark, folder):
    pick = F.element_at(F.array(*[F.lit(s) for s in ("now", "past", "future", "odd")]), (F.col("id") % 4 + 1).cast("int"))
    log = src.assertions(spark, folder).withColumns({"temporal_status": pick, "event_date": F.when(F.col("id") % 3 == 0, F.to_date("ts")), "polarity": F.when(F.col("id") % 5 == 0, F.lit("negated"))})
    return store.conflict_insert(log)


@register(
    "provenance_cleanup",
    """SELECT event_id AS id, CASE WHEN p = 'user_correction' THEN 'user_stated' WHEN p IN ('user_stated', 'llm_inferred', 'llm_learned') THEN p ELSE 'llm_inferred' END AS provenance
    FROM (SELECT event_id, ['user_correction', 'user_stated', 'chat', 'llm_learned', NULL, 'confirmed'][event_id % 6 + 1] AS p FROM events)""",
)
def provenance_cleanup(spark, folder):
    p = F.element_at(F.array(*[F.lit(x) for x in ("user_correction", "user_stated", "chat", "llm_learned", None, "confirmed")]), (F.col("event_id") % 6 + 1).cast("int"))
    return src.table(spark, folder, "events").select(F.col("event_id").alias("id"), store.clean_provenance(p).alias("provenance"))


@register(
    "approve_novel_relations",
    f"""WITH {src.ASSERTIONS}, rels AS (SELECT * FROM (VALUES ('view', 'C', 'seed', 0.9), ('click', 'C', 'engine', 0.6), ('error', 'A', 'seed', 1.0), ('unused', 'C', 'engine', 0.5)) t(rel_type, fact_class, source, confidence)), n AS (SELECT DISTINCT rel_type FROM assertions)
    SELECT coalesce(r.rel_type, n.rel_type) AS rel_type, CASE WHEN r.rel_type IS NULL OR (n.rel_type IS NOT NULL AND fact_class = 'C' AND source <> 'seed') THEN 'B' ELSE fact_class END AS fact_class,
        coalesce(source, 'engine') AS source, CAST(coalesce(confidence, 0.7) AS DOUBLE) AS confidence FROM rels r FULL JOIN n ON n.rel_type = r.rel_type""",
)
def approve_novel_relations(spark, folder):
    rels = spark.createDataFrame([("view", "C", "seed", 0.9), ("click", "C", "engine", 0.6), ("error", "A", "seed", 1.0), ("unused", "C", "engine", 0.5)], "rel_type string, fact_class string, source string, confidence double")
    return store.approve_novel(rels, src.assertions(spark, folder), rels.where("source = 'seed'"))


@register(
    "scalars_to_attributes",
    """WITH v AS (SELECT 'part:' || p_partkey AS entity_id, unnest(['size', 'price', 'made_on', 'brand']) AS attribute, unnest([CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN '12.50' ELSE '9.' END, CASE WHEN p_partkey % 3 = 0 THEN '2024-02-30' ELSE '2024-02-28' END, p_brand]) AS object FROM part)
    SELECT entity_id, attribute, CASE WHEN regexp_full_match(object, '\\d+') THEN TRY_CAST(object AS BIGINT) END AS value_int, CASE WHEN regexp_full_match(object, '\\d+(\\.\\d+)?') THEN TRY_CAST(object AS DOUBLE) END AS value_float,
        CASE WHEN regexp_full_match(object, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(object AS DATE) END AS value_date, CASE WHEN NOT regexp_full_match(object, '\\d+(\\.\\d+)?|\\d{4}-\\d{2}-\\d{2}') THEN object END AS value_text FROM v""",
)
def scalars_to_attributes(spark, folder):
    pairs = F.array(
        F.struct(F.lit("size").alias("rel_type"), F.col("p_size").cast("string").alias("object")),
        F.struct(F.lit("price").alias("rel_type"), F.when(F.col("p_partkey") % 2 == 0, F.lit("12.50")).otherwise(F.lit("9.")).alias("object")),
        F.struct(F.lit("made_on").alias("rel_type"), F.when(F.col("p_partkey") % 3 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-02-28")).alias("object")),
        F.struct(F.lit("brand").alias("rel_type"), F.col("p_brand").alias("object")),
    )
    rows = src.table(spark, folder, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("subject"), F.inline(pairs))
    never = F.lit(None).cast("timestamp_ntz")
    return store.scalars_to_attributes(rows.withColumns({"superseded_at": never, "deleted_at": never}))
