"""Sentences about facts: agreement, shapes of objects, names in their case, and what is said twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import rendering
from factloom.plans.filter_queries import _said_sql, said
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

SPOKEN = ["you's preferred name is chris", "you is the parent of cyrus", "you has a pet that is rex", "you was born in guelph", "you likes art", "", "sarah knows sarahjane"]
TEMPLATES = ["X has a pet that is Y", "You own Y", "{x} supplies {y}", "", "Y of X"]


def _agreed_sql(text: str) -> str:
    for wrong, right in rendering.AGREEMENT:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, wrong.replace("'", "''"), right)
    return text


@register("you_agreement", f"WITH {_said_sql(SPOKEN)} SELECT key, {_agreed_sql('text')} AS text FROM s")
def you_agreement(spark, folder):
    return said(spark, folder, SPOKEN).select("key", rendering.agreed(F.col("text")).alias("text"))


@register("template_verbs", f"WITH {_said_sql(TEMPLATES)} SELECT key, nullif(lower(regexp_extract(text, '^(?:[Xx]|[Yy]ou|\\{{x\\}})\\s+([A-Za-z]+)\\b', 1)), '') AS verb FROM s")
def template_verbs(spark, folder):
    return said(spark, folder, TEMPLATES).select("key", rendering.template_verb(F.col("text")).alias("verb"))


@register(
    "titled_names",
    f"""WITH {_said_sql(SPOKEN)} SELECT key, regexp_replace(regexp_replace(regexp_replace(text, '\\bsarahjane\\b', 'Sarahjane', 'g'), '\\bsarah\\b', 'Sarah', 'g'), '\\brex\\b', 'Rex', 'g') AS text FROM s""",
)
def titled_names(spark, folder):
    names = F.array(*[F.lit(n) for n in ("sarah", "sarahjane", "rex", "you", "")])
    return said(spark, folder, SPOKEN).select("key", rendering.titled(F.col("text"), names).alias("text"))


SHAPED = f"""{src.ASSERTIONS}, c AS (SELECT id, subject, ['instance_of', 'has_pet', 'age', 'owns'][id % 4 + 1] AS rel_type, CASE WHEN id % 9 = 0 THEN 'dog' ELSE object END AS object, CASE WHEN id % 3 = 0 THEN 'dog' WHEN id % 3 = 1 THEN 'SSD' END AS kind, id % 5 = 0 AS is_you FROM assertions),
    v AS (SELECT *, CASE WHEN is_you THEN 'you' ELSE subject END AS who, CASE WHEN rel_type = 'owns' THEN CASE WHEN is_you THEN 'own' ELSE 'owns' END END AS verb FROM c)"""


@register(
    "object_clauses",
    f"""WITH {SHAPED} SELECT id, CASE WHEN rel_type = 'instance_of' THEN who || CASE WHEN is_you THEN ' are ' ELSE ' is ' END || CASE WHEN regexp_matches(lower(object), '^[aeiou]') THEN 'an ' ELSE 'a ' END || object
        WHEN rel_type = 'age' THEN CASE WHEN is_you THEN 'your' ELSE who || '''s' END || ' age is ' || object
        WHEN kind IS NOT NULL AND kind <> object THEN who || ' ' || coalesce(verb, 'has') || CASE WHEN kind = 'SSD' THEN ' an ' ELSE ' a ' END || kind || ' named ' || object END AS clause FROM v""",
)
def object_clauses(spark, folder):
    key = F.col("id")
    rel = F.element_at(F.array(*[F.lit(r) for r in ("instance_of", "has_pet", "age", "owns")]), (key % 4 + 1).cast("int"))
    rows = src.assertions(spark, folder).select("id", "subject", rel.alias("rel_type"), F.when(key % 9 == 0, F.lit("dog")).otherwise(F.col("object")).alias("object"), F.when(key % 3 == 0, F.lit("dog")).when(key % 3 == 1, F.lit("SSD")).alias("kind"), (key % 5 == 0).alias("is_you"))
    who = F.when(F.col("is_you"), F.lit("you")).otherwise(F.col("subject"))
    verb = F.when(F.col("rel_type") == "owns", F.when(F.col("is_you"), F.lit("own")).otherwise(F.lit("owns")))
    clause = rendering.object_clause(F.col("rel_type"), who, F.col("object"), F.col("kind"), F.col("is_you"), verb, F.lit(True), F.col("rel_type") == "age")
    return rows.select("id", clause.alias("clause"))


@register(
    "inverse_pairs",
    """WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'a' || (user_id % 7) ELSE 'b' || (event_id % 5) END AS subject, CASE WHEN event_id % 3 = 0 THEN 'knows' WHEN event_id % 2 = 0 THEN 'parent_of' ELSE 'child_of' END AS rel_type,
            CASE WHEN event_id % 2 = 0 THEN 'b' || (event_id % 5) ELSE 'a' || (user_id % 7) END AS object FROM events),
        p AS (SELECT *, subject LIKE 'b%' AS is_you, CASE WHEN rel_type = 'parent_of' THEN ('child_of', object, subject) ELSE (rel_type, subject, object) END AS pair FROM r)
    SELECT id, subject, rel_type, object, is_you FROM p QUALIFY row_number() OVER (PARTITION BY pair ORDER BY NOT is_you, id) = 1""",
)
def inverse_pairs(spark, folder):
    key = F.col("event_id")
    a, b = F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")), F.concat(F.lit("b"), (key % 5).cast("string"))
    rel = F.when(key % 3 == 0, F.lit("knows")).when(key % 2 == 0, F.lit("parent_of")).otherwise(F.lit("child_of"))
    rows = src.table(spark, folder, "events").select(key.alias("id"), F.when(key % 2 == 0, a).otherwise(b).alias("subject"), rel.alias("rel_type"), F.when(key % 2 == 0, b).otherwise(a).alias("object"))
    inverses = spark.createDataFrame([("parent_of", "child_of"), ("child_of", "parent_of")], "rel_type string, inverse string")
    return rendering.inverse_pairs(rows.withColumn("is_you", F.col("subject").like("b%")), inverses)
