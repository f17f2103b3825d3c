"""What part of a memory a request is about: times, groups, attributes, sure and unsure edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.store import LIVE_FACT

SURE = 0.4  # edges below are context

#: What groups are called in a retraction, in the order in which they are looked for, and how a whole group is meant.
GROUP_WORDS = {
    "pets": ["pet", "dog", "cat", "animal"],
    "family": ["family", "child", "parent", "sibling", "spouse"],
    "work": ["work", "job", "employer", "project", "occupation"],
    "location": ["address", "live", "location", "city", "country"],
}
WHOLE_GROUP = ["don't have any", "don't have a", "no ", "forget all", "delete all"]


def valid_in(facts: DataFrame, scope: Column) -> DataFrame:
    """Facts that hold at the day, or at some time of the range, that a scope (``2024-05-01`` or ``2024-01-01/2024-12-31``) names.

    Both ends of a range count; a fact holds from valid_from until before
    valid_until, ever without them.  A scope that cannot be read bounds nothing.
    """
    parts = F.split(F.trim(scope), "/")
    low = F.get(parts, F.lit(0)).try_cast("date")
    high = F.when(F.size(parts) == 1, low).otherwise(F.get(parts, F.lit(1)).try_cast("date"))
    holds = (F.col("valid_from").isNull() | (F.to_date("valid_from") <= high)) & (F.col("valid_until").isNull() | (F.to_date("valid_until") > low))
    return facts.where(low.isNull() | high.isNull() | (low > high) | holds)


def group_scope(texts: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """(key, scope_level, category, rel_types, entity_types): whether a retraction (key, text) means a whole group or one fact.

    It means a group if the text holds one of its words and a phrase for all of
    it, and the group is a known taxonomy (taxonomy_name, defining_rels,
    members); of several the first in order.
    """
    low = F.lower("text")
    whole = F.exists(F.array(*map(F.lit, WHOLE_GROUP)), lambda p: F.contains(low, p))
    named = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.struct(F.lit(i).alias("rank"), F.lit(group).alias("category"))) for i, (group, words) in enumerate(GROUP_WORDS.items())]
    meant = texts.where(whole).select("key", F.explode(F.array_compact(F.array(*named))).alias("x")).select("key", "x.*")
    known = taxonomies.select(F.col("taxonomy_name").alias("category"), "defining_rels", "members")
    first = meant.join(known, "category").groupBy("key").agg(F.min_by(F.struct("category", "defining_rels", "members"), "rank").alias("g"))
    none = F.array().cast("array<string>")
    return texts.join(first, "key", "left").select(
        "key", F.when(F.col("g").isNotNull(), "categorical").otherwise("granular").alias("scope_level"), F.col("g.category").alias("category"), F.coalesce("g.defining_rels", none).alias("rel_types"), F.coalesce("g.members", none).alias("entity_types")
    )


def about_attribute(attribute: Column, query_words: Column) -> Column:
    """Whether a query is about an attribute: its head, the last word of the name that is no preposition, is among the words; a modifier alone is not enough."""
    parts = F.filter(F.split(F.lower(attribute), "_"), lambda w: (w != "") & ~w.isin("in", "at", "on", "of", "for", "from", "by", "as", "into", "to", "with", "about"))
    return F.coalesce(F.array_contains(query_words, F.try_element_at(parts, F.lit(-1))), F.lit(False))


def split_by_confidence(edges: DataFrame, least: float = SURE) -> tuple[DataFrame, DataFrame]:
    """Edges to store, and those so unsure that they are context only; an edge without a confidence is stored."""
    sure = F.coalesce(F.col("confidence") >= least, F.lit(True))
    return edges.where(sure), edges.where(~sure)


def retrieved(stored: DataFrame, vector_hits: DataFrame, key: str, least: float) -> DataFrame:
    """Stored facts and hits of a vector search in one order by confidence: stored facts always, hits from ``least`` on, none twice."""
    columns = [key, "subject", "rel_type", "object", "confidence"]
    facts = stored.select(*columns, F.lit("facts").alias("source"))
    hits = vector_hits.where(F.col("confidence") >= least).join(facts, [key, "subject", "rel_type", "object"], "left_anti").select(*columns, F.lit("vectors").alias("source"))
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("confidence"), "source", "subject", "rel_type", "object")
    return facts.unionByName(hits).withColumn("position", F.row_number().over(order).cast("long"))


def scalar_history(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(subject, rel_type, object, n, first, last): the values that relations with scalar tails (rel_type, tail_types) ever had, live or not."""
    scalar = relations.where(F.arrays_overlap(F.transform("tail_types", F.lower), F.array(F.lit("scalar")))).select("rel_type")
    return facts.join(scalar, "rel_type", "left_semi").groupBy("subject", "rel_type", "object").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def materialised(facts: DataFrame, staged: DataFrame, confirmations: int = 3) -> DataFrame:
    """Staged facts of class B that were confirmed often enough and that no live fact holds yet; they stay of class B."""
    known = facts.where(LIVE_FACT).select("subject", "rel_type", "object")
    ready = staged.where((F.col("fact_class") == "B") & (F.col("confirmed_count") >= confirmations) & F.expr("promoted_at is null and deleted_at is null"))
    return ready.join(known, ["subject", "rel_type", "object"], "left_anti")


def rechecked(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges (rel_type, subject_type, object_type) with recheck: ok, subject or object, against the relations as they were just written (rel_type, head_types, tail_types).

    Unknown types and unknown relations pass, and so do open and, for objects,
    scalar constraints.
    """
    now = relations.select(F.lower("rel_type").alias("_low"), F.transform("head_types", F.lower).alias("_head"), F.transform("tail_types", F.lower).alias("_tail"))
    fits = lambda kinds, kind, open_words: (
        F.col(kinds).isNull() | F.array_contains(kinds, "any") | ((F.size(kinds) == 1) & F.get(kinds, F.lit(0)).isin(open_words)) | (F.coalesce(F.trim(F.lower(kind)), F.lit("")).isin("", "unknown")) | F.array_contains(kinds, F.trim(F.lower(kind)))
    )
    met = edges.withColumn("_low", F.lower("rel_type")).join(now, "_low", "left")
    return met.select(*edges.columns, F.when(~fits("_head", "subject_type", ["any"]), "subject").when(~fits("_tail", "object_type", ["any", "scalar"]), "object").otherwise("ok").alias("recheck"))


def registered(entities: DataFrame, registry: DataFrame, known_types: DataFrame) -> DataFrame:
    """(id, name, type, canonical_id, is_duplicate) of entities (id, name, type): the registered one of the same name and type, else a new one for each.

    A type that is not known raises an error when the rows are read.  New
    entities of a type get numbers that follow those that the registry
    (canonical_id, name, type) has of it, by the id of their first mention.
    """
    clean = lambda c: F.lower(F.trim(c))
    types = known_types.select(F.col("type").alias("type"), F.lit(True).alias("_known"))
    asked = entities.join(types, "type", "left").withColumn("_n", clean("name")).withColumn("_t", F.when(F.col("_known"), clean("type")).otherwise(F.raise_error(F.concat(F.lit("novel type: "), F.coalesce("type", F.lit("null"))))))
    held = registry.select(clean("name").alias("_n"), clean("type").alias("_t"), "canonical_id").groupBy("_n", "_t").agg(F.min("canonical_id").alias("held"))
    counts = registry.groupBy(clean("type").alias("_t")).agg(F.count("*").alias("_before"))
    met = asked.join(held, ["_n", "_t"], "left").join(counts, "_t", "left").withColumn("_first", F.min("id").over(Window.partitionBy("_n", "_t")))
    fresh = met.where("held is null").select("_t", "_n", "_first", F.coalesce("_before", F.lit(0)).alias("_before")).distinct()
    number = F.row_number().over(Window.partitionBy("_t").orderBy("_first", "_n")) + F.col("_before") - 1
    named = fresh.select("_t", "_n", F.concat(F.col("_t"), F.lit("-"), number.cast("string")).alias("made"))
    out = met.join(named, ["_t", "_n"], "left")
    return out.select("id", "name", "type", F.coalesce("held", "made").alias("canonical_id"), (F.col("held").isNotNull() | (F.col("id") != F.col("_first"))).alias("is_duplicate"))


def inverse_clause(relation: DataFrame, you: Column, anchor: Column, instance: Column, kind: Column) -> Column:
    """``you have a son named cyrus`` of (cyrus, child_of, you), from the relation's inverse (inverse_rel_type, is_symmetric, label); null if it cannot be turned.

    A symmetric relation says what the instance is to the anchor; an instance
    without a type, or a relation without an inverse, says nothing.
    """
    verb = F.when(you, "have").otherwise("has")
    article = F.when(F.lower(kind).rlike("^[aeiou]"), "an").otherwise("a")
    whose = F.when(you, "your").otherwise(F.concat(anchor, F.lit("'s")))
    symmetric = F.coalesce(relation["is_symmetric"], F.lit(False))
    return F.when(symmetric & relation["label"].isNotNull(), F.concat_ws(" ", instance, F.lit("is"), whose, relation["label"])).when(
        ~symmetric & (F.coalesce(relation["inverse_rel_type"], F.lit("")) != "") & (F.coalesce(kind, F.lit("")) != ""), F.concat_ws(" ", anchor, verb, article, kind, F.lit("named"), instance)
    )


def normal_triple(rows: DataFrame) -> DataFrame:
    """Rows whose subject, relation and object are lowered and trimmed."""
    return rows.withColumns({c: F.lower(F.trim(c)) for c in ("subject", "rel_type", "object")})


def scoped_key(namespace: str, scope: Column, *parts: Column) -> Column:
    """A key ``namespace:scope:parts``; a namespace with other than a-z, 0-9 and _ is refused, and so is a row without a scope."""
    if not namespace or not set(namespace) <= set("abcdefghijklmnopqrstuvwxyz0123456789_"):
        raise ValueError(f"namespace {namespace!r}")
    held = F.trim(F.coalesce(scope, F.lit("")))
    return F.when(held == "", F.raise_error(F.lit("a key needs a scope"))).otherwise(F.concat_ws(":", F.lit(namespace), F.left(F.sha2(held, 256), F.lit(20)), *parts))
