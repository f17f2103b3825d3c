"""Who a name is: resolution to ids, and the rewrite of names and merged ids in all tables together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.texts import uuid5
from factloom.scratch import staged

LONGEST_NAME = 256
#: The namespace of ids whose user is no UUID, and the words for oneself.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
SELF_WORDS = ["user", "i", "me", "my", "myself", "mine"]
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def is_uuid(value: Column) -> Column:
    return F.coalesce(F.lower(value).rlike(UUID), F.lit(False))


def clean_name(name: Column) -> Column:
    """Lowered and trimmed, of 256 characters at most, as the surveyed system stores names."""
    return F.left(F.trim(F.lower(name)), F.lit(LONGEST_NAME))


def surrogate(user: Column, name: Column) -> Column:
    """The version 5 UUID of a user's name; a user whose id is no UUID is part of what is hashed."""
    return uuid5(NAMESPACE, F.concat(F.lower(user), F.lit(":"), name))


def resolved(names: DataFrame, aliases: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(user_id, name, entity_id, rung) of names (user_id, name): self, alias, entity, relation (rejected: null id) or minted.

    A word for oneself is the user.  An alias (user_id, alias, entity_id,
    preferred) that points to a UUID comes next: the user's own id first, then
    the preferred, then the least.  Then an entity (user_id, entity_id) of that
    id.  The name of a relation (rel_type) is no entity; any other name gets a
    new id.  A blank name has no row.
    """
    asked = names.select("user_id", clean_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    known = aliases.where(is_uuid(F.col("entity_id"))).select("user_id", clean_name(F.col("alias")).alias("name"), F.lower("entity_id").alias("a"), "preferred")
    order = F.struct((F.col("a") != F.lower("user_id")).alias("other"), (~F.coalesce("preferred", F.lit(False))).alias("plain"), "a")
    known = known.groupBy("user_id", "name").agg(F.min_by("a", order).alias("by_alias"))
    there = entities.where(is_uuid(F.col("entity_id"))).select("user_id", F.lower("entity_id").alias("name"), F.lit(True).alias("by_id")).distinct()
    named = relations.select(F.lower("rel_type").alias("name"), F.lit(True).alias("is_relation")).distinct()
    met = asked.join(known, ["user_id", "name"], "left").join(there, ["user_id", "name"], "left").join(named, "name", "left")
    me = F.when(is_uuid(F.col("user_id")), F.lower("user_id")).otherwise(surrogate(F.col("user_id"), F.lower("user_id")))
    cases = [(F.col("name").isin(SELF_WORDS), "self", me), (F.col("by_alias").isNotNull(), "alias", F.col("by_alias")), (F.col("by_id"), "entity", F.col("name")), (F.col("is_relation"), "relation", F.lit(None).cast("string"))]
    pick = lambda of: reduce(lambda w, c: w.when(c[0], of(c)), cases[1:], F.when(cases[0][0], of(cases[0])))
    return met.select("user_id", "name", pick(lambda c: c[2]).otherwise(surrogate(F.col("user_id"), F.col("name"))).alias("entity_id"), pick(lambda c: F.lit(c[1])).otherwise("minted").alias("rung"))


def minted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``resolved``: the entities (user_id, entity_id, entity_type) and preferred aliases that new names bring."""
    new = found.where("rung = 'minted'")
    return new.select("user_id", "entity_id", F.lit("unknown").alias("entity_type")).distinct(), new.select("user_id", F.col("name").alias("alias"), "entity_id", F.lit(True).alias("preferred"))


def components(links: DataFrame) -> DataFrame:
    """(id, least): for every id of the links (a, b) the least id that it hangs together with.

    Each id takes the least label around it, and then its label's label, until
    none changes; a chain halves at every round.  Labels are aggregated before
    they are shuffled, so a hub costs a row a task.
    """
    both = links.where("a is not null and b is not null").select("a", "b").unionByName(links.where("a is not null and b is not null").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(both.distinct(), "identity-edges")
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("least")), "identity-labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("b"), "least"), "b").groupBy(F.col("a").alias("id")).agg(F.min("least").alias("near"))
        nearer = labels.join(around, "id").select("id", F.least("least", "near").alias("next"), "least")
        jumped = nearer.join(labels.select(F.col("id").alias("next"), F.col("least").alias("beyond")), "next", "left")
        new = staged(jumped.select("id", F.least("next", F.coalesce("beyond", "next")).alias("least"), F.col("least").alias("was")), "identity-labels")
        if new.where("least <> was").isEmpty():
            return new.select("id", "least")
        labels = new.select("id", "least")


def id_map(tables: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """(user_id, id, entity_id): what each id of the tables (columns of the names in ID_COLUMNS) becomes.

    A name becomes its surrogate.  Ids that hang together by ``links`` (user_id, a,
    b) become one: the user's own id if it is among them, else the least.
    """
    columns = [(t, c) for t, columns in ID_COLUMNS.items() if t in tables for c in columns]
    ids = reduce(DataFrame.unionByName, [tables[t].select("user_id", F.col(c).alias("id")) for t, c in columns] + [links.select("user_id", F.col(c).alias("id")) for c in ("a", "b")])
    ids = ids.where("id is not null").distinct()
    to = F.when(is_uuid(F.col("id")), F.lower("id")).when(clean_name(F.col("id")).isin(SELF_WORDS) & is_uuid(F.col("user_id")), F.lower("user_id")).otherwise(surrogate(F.col("user_id"), clean_name(F.col("id"))))
    plain = staged(ids.select("user_id", "id", to.alias("to")), "identity-ids")
    ends = links.join(plain.select("user_id", F.col("id").alias("a"), F.col("to").alias("to_a")), ["user_id", "a"]).join(plain.select("user_id", F.col("id").alias("b"), F.col("to").alias("to_b")), ["user_id", "b"])
    scoped = lambda c: F.concat_ws("\u001f", "user_id", c)
    merged = components(ends.where("to_a <> to_b").select(scoped("to_a").alias("a"), scoped("to_b").alias("b")))
    parts = merged.select(F.split("id", "\u001f")[0].alias("user_id"), F.split("id", "\u001f")[1].alias("to"), F.split("least", "\u001f")[1].alias("least"))
    mine = parts.where("to = lower(user_id)").select("user_id", "least", F.col("to").alias("own"))
    parts = parts.join(mine, ["user_id", "least"], "left").select("user_id", "to", F.coalesce("own", "least").alias("one"))
    return staged(plain.join(parts, ["user_id", "to"], "left").select("user_id", "id", F.coalesce("one", "to").alias("entity_id")), "identity-map")


#: Which columns of which tables hold ids.
ID_COLUMNS = {"facts": ["subject_id", "object_id"], "staged_facts": ["subject_id", "object_id"], "aliases": ["entity_id"], "attributes": ["entity_id"], "entities": ["entity_id"]}


def rewritten(tables: dict[str, DataFrame], links: DataFrame) -> dict[str, DataFrame]:
    """New versions of the tables, in which every id is a UUID and merged ids are one.

    Rows of facts that become equal in subject, relation and object keep the one
    of highest confidence; of aliases, the preferred one; of attributes, the
    latest; a relation of a thing to itself that the merge brought goes.  Every
    id of facts is an entity, and each has an alias: a name that was an id stays
    as one.  Run again on its own result it changes nothing.
    """
    ids = id_map(tables, links)
    out = {}
    for name, columns in ID_COLUMNS.items():
        if name not in tables:
            continue
        rows = tables[name]
        for c in columns:
            new = ids.select("user_id", F.col("id").alias(c), F.col("entity_id").alias("_to"))
            rows = rows.join(new, ["user_id", c], "left").withColumn(c, F.col("_to")).drop("_to")
        out[name] = rows.select(*tables[name].columns)
    for name in ("facts", "staged_facts"):
        if name in out:
            was_self = ids.groupBy("user_id", "entity_id").count().where("count > 1").select("user_id", F.col("entity_id").alias("subject_id"), F.lit(True).alias("merged"))
            kept = out[name].join(was_self, ["user_id", "subject_id"], "left").where("subject_id <> object_id or merged is null").drop("merged")
            out[name] = _best(kept, ["user_id", "subject_id", "rel_type", "object_id"], ["confidence"])
    if "attributes" in out:
        out["attributes"] = _best(out["attributes"], ["user_id", "entity_id", "attribute"], ["updated_at"])
    names = ids.where(~is_uuid(F.col("id"))).groupBy("user_id", "entity_id").agg(F.min(clean_name(F.col("id"))).alias("alias"))
    if "aliases" in out:
        held = out["aliases"].groupBy("user_id", "entity_id", "alias").agg(F.bool_or("preferred").alias("preferred"))
        lacking = names.join(held.select("user_id", "entity_id"), ["user_id", "entity_id"], "left_anti").join(held.select("user_id", "alias"), ["user_id", "alias"], "left_anti")
        out["aliases"] = held.unionByName(lacking.select("user_id", "entity_id", "alias", F.lit(True).alias("preferred")))
    if "entities" in out:
        known = out["entities"].groupBy("user_id", "entity_id").agg(F.coalesce(F.min(F.when(F.col("entity_type") != "unknown", F.col("entity_type"))), F.lit("unknown")).alias("entity_type"))
        every = ids.select("user_id", "entity_id").distinct().join(known, ["user_id", "entity_id"], "left")
        out["entities"] = every.select("user_id", "entity_id", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"))
    return out


def _best(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One whole row of each key: the highest by ``by``, then by the rest."""
    rest = [c for c in rows.columns if c not in key and c not in by]
    return rows.groupBy(*key).agg(F.max(F.struct(*by, *rest)).alias("x")).select(*[c if c in key else F.col("x")[c].alias(c) for c in rows.columns])
