"""The two tables of a memory, facts and staged facts: what of them is live, and what retractions and corrections change.

Tables are not updated in place: each function gives the rows that are read, or the rows as they are after a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIVE_FACT = "superseded_at is null and deleted_at is null"
LIVE_STAGED = "promoted_at is null and deleted_at is null"

#: Fixed values: (new relation, relation that it contradicts).
CONTRADICTING = [
    ("instance_of", "has_pet"),
    ("instance_of", "owns"),
    ("instance_of", "likes"),
    ("instance_of", "dislikes"),
    ("instance_of", "prefers"),
    ("subclass_of", "has_pet"),
    ("subclass_of", "owns"),
]


def live(facts: DataFrame, staged: DataFrame) -> DataFrame:
    """The live rows of both tables, with the table they come from."""
    columns = ["id", "subject", "rel_type", "object", "confidence", "fact_class"]
    return facts.where(LIVE_FACT).select(*columns, F.lit("facts").alias("source_table")).unionByName(staged.where(LIVE_STAGED).select(*columns, F.lit("staged_facts").alias("source_table")))


def readable(facts: DataFrame, history: bool = False) -> DataFrame:
    """Facts that a reader sees: those not archived, or all where history is asked for."""
    return facts if history else facts.where("archived_at is null")


def retraction_targets(requests: DataFrame, facts: DataFrame, staged: DataFrame, mode: str = "supersede") -> DataFrame:
    """(request, id, source_table, label): the rows that each request (request, subject, rel_type, old_value) means.

    In facts these are the rows of its subject, else those that have it as
    object; relation and old value narrow them where they are given, the old
    value only on the subject's side.  In staged facts either side counts;
    they are looked at if facts has none, or always when forgetting or
    restoring.  Restoring looks among tombstoned rows.  The label says which
    tables a request's rows lie in.
    """
    dual = mode in ("hard_delete", "unforget")
    of_facts = facts.where("deleted_at is not null" if mode == "unforget" else LIVE_FACT)
    of_staged = staged.where("deleted_at is not null" if mode == "unforget" else LIVE_STAGED)
    named = "(r.rel_type is null or lower(r.rel_type) = f.rel_type)"
    valued = "(r.old_value is null or r.old_value = f.object)"
    r = requests.alias("r")
    one = lambda table, side, rule, n: r.join(table.alias("f"), F.expr(f"r.subject = f.{side} and {named} and {rule}")).select("r.request", "f.id", F.lit(n).alias("rank"))
    found = one(of_facts, "subject", valued, 0).unionByName(one(of_facts, "object", "true", 1))
    best = found.groupBy("request").agg(F.min("rank").alias("rank"))
    in_facts = found.join(best, ["request", "rank"]).select("request", "id", F.lit("facts").alias("source_table"))
    in_staged = one(of_staged, "subject", valued, 0).unionByName(one(of_staged, "object", valued, 1)).select("request", "id", F.lit("staged_facts").alias("source_table")).distinct()
    if not dual:
        in_staged = in_staged.join(best, "request", "left_anti")
    both = in_facts.unionByName(in_staged)
    tables = both.groupBy("request").agg(F.when(F.count_distinct("source_table") > 1, F.lit("both")).otherwise(F.min("source_table")).alias("label"))
    return both.join(tables, "request")


def retracted(facts: DataFrame, targets: DataFrame, mode: str, now: str) -> DataFrame:
    """Facts after the retraction of targets (id): superseded, forgotten or restored."""
    moment = F.lit(now).cast("timestamp_ntz")
    marked = facts.join(targets.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    change = {"supersede": {"superseded_at": moment}, "hard_delete": {"archived_at": moment, "deleted_at": moment}, "unforget": {"archived_at": F.lit(None), "deleted_at": F.lit(None)}}[mode]
    return marked.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in change.items()}).drop("hit")


def correction_action(edges: DataFrame, behaviours: DataFrame) -> DataFrame:
    """What a correction does by its relation's behaviour (rel_type, correction_behavior), supersede where none is set; other edges are accepted."""
    known = F.coalesce("correction_behavior", F.lit("supersede"))
    action = F.when(~F.coalesce("is_correction", F.lit(False)), F.lit("accept")).when(known.isin("hard_delete", "supersede", "immutable"), known).otherwise(F.lit("accept"))
    return edges.join(behaviours, "rel_type", "left").withColumn("action", action).drop("correction_behavior")


def archive_contradicted(facts: DataFrame, corrections: DataFrame, pairs: list[tuple[str, str]] = CONTRADICTING) -> DataFrame:
    """The ids of facts that corrections (subject, rel_type) of their subject contradict."""
    listed = F.array(*[F.struct(F.lit(a).alias("rel_type"), F.lit(b).alias("against")) for a, b in pairs])
    table = corrections.sparkSession.range(1).select(F.inline(listed))
    hit = corrections.join(table, "rel_type").select("subject", F.col("against").alias("rel_type")).distinct()
    return facts.where("archived_at is null").join(hit, ["subject", "rel_type"], "left_semi")


def drop_staged_conflicts(staged: DataFrame, corrections: DataFrame) -> DataFrame:
    """Staged facts without those of a corrected subject and relation that name another object."""
    now = corrections.select("subject", "rel_type", F.col("object").alias("right")).distinct()
    gone = staged.join(now, ["subject", "rel_type"]).groupBy("id").agg(F.bool_or(F.col("object") == F.col("right")).alias("same")).where("not same").select("id")
    return staged.join(gone, "id", "left_anti")


def conflict_insert(log: DataFrame) -> DataFrame:
    """One row per triple of dated assertions (ts, id, temporal_status, event_date, polarity): a bare now, or no date, never takes the place of an older stamp; polarity is the latest."""
    order = F.struct("ts", "id")
    dated = F.col("temporal_status").isin("past", "future")
    return log.groupBy("subject", "rel_type", "object").agg(
        F.coalesce(F.max_by("temporal_status", F.when(dated, order)), F.lit("now")).alias("temporal_status"),
        F.max_by("event_date", F.when(F.col("event_date").isNotNull(), order)).alias("event_date"),
        F.max_by(F.when(F.col("polarity") == "negated", F.lit("negated")).otherwise(F.lit("affirmed")), order).alias("polarity"),
    )


def clean_provenance(provenance):
    """One of the three provenances that are kept."""
    return F.when(provenance == "user_correction", F.lit("user_stated")).when(provenance.isin("user_stated", "llm_inferred", "llm_learned"), provenance).otherwise(F.lit("llm_inferred"))


def approve_novel(rels: DataFrame, novel: DataFrame, seeded: DataFrame) -> DataFrame:
    """The ontology (rel_type, fact_class, source, confidence) after novel relations are approved: new ones are B at 0.7, grown ones of class C become B, seeded ones stay."""
    new = novel.select("rel_type").distinct().withColumn("asked", F.lit(True))
    old = seeded.select("rel_type").distinct().withColumn("seed", F.lit(True))
    rows = rels.join(new, "rel_type", "full").join(old, "rel_type", "left")
    grown = F.col("asked") & (F.col("fact_class") == "C") & F.col("seed").isNull()
    return rows.select(
        "rel_type",
        F.when(F.col("fact_class").isNull() | F.coalesce(grown, F.lit(False)), F.lit("B")).otherwise(F.col("fact_class")).alias("fact_class"),
        F.coalesce("source", F.lit("engine")).alias("source"),
        F.coalesce("confidence", F.lit(0.7)).alias("confidence"),
    )


def scalars_to_attributes(facts: DataFrame) -> DataFrame:
    """(entity_id, attribute, value_int, value_float, value_date, value_text): live scalar facts with guarded casts."""
    value = F.trim("object")
    whole, decimal, date = value.rlike(r"^\d+$"), value.rlike(r"^\d+\.\d+$"), value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return facts.where(LIVE_FACT).select(
        F.col("subject").alias("entity_id"),
        F.col("rel_type").alias("attribute"),
        F.when(whole, value.try_cast("long")).alias("value_int"),
        F.when(whole | decimal, value.try_cast("double")).alias("value_float"),
        F.when(date, value.try_cast("date")).alias("value_date"),
        F.when(~(whole | decimal | date), value).alias("value_text"),
    )
