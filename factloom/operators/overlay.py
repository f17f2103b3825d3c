"""Ontologies of tenants over a seed: which rows hold, and how the seed comes in.

Tables are immutable; each function returns the next version.  All tenants are
treated at once, ``tenant_id`` being part of every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.morphology import normal_form

#: The metadata of a relation that the seed owns, the groups of cues that tenants grow themselves, and who may record an alias.
SEED_COLUMNS = (
    "head_types tail_types is_symmetric inverse_rel_type is_hierarchy_rel is_leaf_only allows_leaf_rels category fact_class natural_language natural_language_2p "
    "correction_behavior label wikidata_pid storage_target temporal_class"
).split()
GROWN_CUES = ["social_role", "problem_noun", "thin_type"]
ALIAS_SOURCES = ["engine", "user_corrected"]
CORRECTED = "user_corrected"


def first_rung(tenants: DataFrame, overlay: DataFrame, registry: DataFrame, seed: DataFrame) -> DataFrame:
    """Each tenant's ontology from the first rung that has any of it: its overlay, what the registry has of it, else the seed.

    Rungs are never mixed.  ``overlay`` and ``registry`` have tenant_id and the
    columns of ``seed``; a null tenant_id of ``tenants`` is a session without a
    tenant, which has the seed.  The column rung tells where rows come from.
    """
    columns = [c for c in seed.columns if c != "tenant_id"]
    asked = tenants.select("tenant_id").distinct()
    has = lambda rows, name: rows.select("tenant_id").where("tenant_id is not null").distinct().withColumn(name, F.lit(True))
    rung = F.when(F.col("own"), "overlay").when(F.col("registered"), "registry").otherwise("seed")
    chosen = asked.join(has(overlay, "own"), "tenant_id", "left").join(has(registry, "registered"), "tenant_id", "left").select("tenant_id", rung.alias("rung"))
    scoped = [chosen.where(f"rung = '{name}'").join(rows.select("tenant_id", *columns), "tenant_id") for name, rows in (("overlay", overlay), ("registry", registry))]
    whole = chosen.where("rung = 'seed'").join(seed.select(*columns))  # by definition every such tenant with every row
    return reduce(DataFrame.unionByName, [*scoped, whole]).select("tenant_id", "rung", *columns)


def seeded(tenant: DataFrame, seed: DataFrame, tenants: DataFrame, key: list[str], owned: list[str], keeps=None) -> DataFrame:
    """The tenants' rows after a copy of the seed: missing rows come in, of present ones the ``owned`` columns follow the seed.

    All other columns stay the tenant's.  A row that ``keeps`` holds for (by
    default one that a user corrected) stays as it is.
    """
    keeps = F.coalesce(F.col("source") == CORRECTED, F.lit(False)) if keeps is None else keeps
    offered = tenants.select("tenant_id").distinct().join(seed.withColumn("_one", F.lit(True)))
    fresh = offered.select("tenant_id", *key, *[F.col(c).alias(f"_{c}") for c in owned if c not in key], "_one")
    met = tenant.join(fresh, ["tenant_id", *key], "left")
    now = met.select(*[F.when(F.col("_one") & ~keeps, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in owned and c not in key else F.col(c) for c in tenant.columns])
    return now.unionByName(missing(tenant, offered.drop("_one"), ["tenant_id", *key]).select(*[c if c in offered.columns else F.lit(None).cast(tenant.schema[c].dataType).alias(c) for c in tenant.columns]))


def missing(rows: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """The offered rows whose key is not there."""
    return offered.join(rows.select(*key), key, "left_anti")


def seeded_aliases(aliases: DataFrame, seed: DataFrame, relations: DataFrame) -> DataFrame:
    """The tenants' aliases with those of the seed that they lack and whose relation they know."""
    offered = seed.join(relations.select("tenant_id", F.col("rel_type").alias("canonical")).distinct(), "canonical")
    return aliases.unionByName(missing(aliases, offered, ["tenant_id", "alias"]).select(*aliases.columns))


def seeded_cues(cues: DataFrame, seed: DataFrame, tenants: DataFrame) -> DataFrame:
    """The tenants' cues with those of the seed that they lack, but for the groups that each grows itself."""
    offered = tenants.select("tenant_id").distinct().join(seed.where(~F.col("category").isin(GROWN_CUES)))
    return cues.unionByName(missing(cues, offered, ["tenant_id", "cue", "category"]).select(*cues.columns))


def nested(taxonomies: DataFrame, parent: str = "family", child: str = "pets") -> DataFrame:
    """Taxonomies in which ``parent`` takes ``child`` in, unless a user corrected it or it has members already."""
    free = (F.col("taxonomy_name") == parent) & (F.coalesce("source", F.lit("seeded")) != CORRECTED) & (F.coalesce(F.size("member_taxonomies"), F.lit(0)) <= 0)
    taken = F.when(free, F.array(F.lit(child))).otherwise(F.col("member_taxonomies"))
    return taxonomies.withColumn("is_hierarchical", F.when(free, F.lit(True)).otherwise(F.col("is_hierarchical"))).withColumn("member_taxonomies", taken)


def with_source(taxonomies: DataFrame) -> DataFrame:
    """Taxonomies of any vintage: one without a source, or without that column, is of the seed."""
    source = F.coalesce(F.col("source"), F.lit("seeded")) if "source" in taxonomies.columns else F.lit("seeded")
    return taxonomies.withColumn("source", source)


def recorded_aliases(aliases: DataFrame, claims: DataFrame) -> DataFrame:
    """Aliases with those of the claims (tenant_id, alias, canonical, requires_inversion, source) that are new.

    An alias is stored in normal form, never for itself, from the engine or a
    user alone, and never over one that is there; of claims to one alias the
    first by canonical name comes in.
    """
    rows = claims.where(F.col("source").isin(ALIAS_SOURCES)).withColumn("alias", normal_form(F.col("alias"))).withColumn("canonical", F.lower(F.trim("canonical")))
    rows = rows.where("alias <> '' and canonical <> '' and alias <> canonical")
    first = rows.groupBy("tenant_id", "alias").agg(F.min(F.struct("canonical", "requires_inversion", "source")).alias("x")).select("tenant_id", "alias", "x.*")
    return aliases.unionByName(missing(aliases, first, ["tenant_id", "alias"]).select(*aliases.columns))


def current(log: DataFrame, key: list[str], at: str = "at") -> DataFrame:
    """The current rows of an append-only log: of a key the last row that a user corrected, else the last; what the seed says later does not undo a correction."""
    rest = [c for c in log.columns if c not in key]
    order = F.struct((F.coalesce(F.col("source"), F.lit("")) == CORRECTED).cast("int"), F.col(at), *[F.col(c) for c in rest if c != at])
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


# --- which relations may define a group ---

CLASSIFYING = ["P31", "P279"]  # fixed values: relations that only classify
OPEN_TYPES = ["any", "scalar"]


def _foreign(types: Column, members: Column) -> Column:
    concrete = F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: ~F.lower(t).isin(OPEN_TYPES))
    return F.exists(concrete, lambda t: ~F.array_contains(members, F.lower(t)))


def eligible_groups(taxonomies: DataFrame, relations: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Taxonomies (taxonomy_name, members, defining_rels, ...) without the defining relations that may not be: order is kept.

    A relation that only classifies goes, and one with a concrete head or tail
    type that is no member; unknown relations stay, and so does all of a taxonomy
    without members, or, but for classifying ones, with the member ``any``.  With
    ``changed`` (rel_type) only taxonomies that these define are derived anew.
    """
    again = taxonomies
    if changed is not None:
        touched = taxonomies.select("taxonomy_name", F.explode("defining_rels").alias("r")).join(changed.select(F.lower("rel_type").alias("low")).distinct(), F.lower("r") == F.col("low"), "left_semi").select("taxonomy_name").distinct()
        again = taxonomies.join(touched, "taxonomy_name", "left_semi")
    meta = relations.select(F.lower("rel_type").alias("low"), "is_hierarchy_rel", "wikidata_pid", "head_types", "tail_types", F.lit(True).alias("known"))
    each = again.select("taxonomy_name", F.transform("members", F.lower).alias("ms"), F.posexplode("defining_rels").alias("i", "r")).withColumn("low", F.lower("r")).join(meta, "low", "left")
    classifies = F.coalesce("is_hierarchy_rel", F.lit(False)) & F.coalesce(F.col("wikidata_pid").isin(CLASSIFYING), F.lit(False))
    crosses = ~F.array_contains("ms", "any") & (_foreign(F.col("head_types"), F.col("ms")) | _foreign(F.col("tail_types"), F.col("ms")))
    stays = F.col("known").isNull() | (F.coalesce(F.size("ms"), F.lit(0)) <= 0) | ~(classifies | F.coalesce(crosses, F.lit(False)))
    kept = each.where(stays).groupBy("taxonomy_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("kept"))
    derived = again.join(kept, "taxonomy_name", "left").withColumn("defining_rels", F.when(F.coalesce(F.size("defining_rels"), F.lit(0)) <= 0, F.col("defining_rels")).otherwise(F.coalesce("kept", F.array().cast("array<string>")))).select(*taxonomies.columns)
    return derived if changed is None else derived.unionByName(taxonomies.join(touched, "taxonomy_name", "left_anti"))


def category_advice(edges: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """Edges with what their relation's category says of them, which never keeps one out.

    ``edges`` has rel_type, category, subject_type and object_type.  advice is
    no_category, unknown_category, other_relation or checked; subject_outside and
    object_outside tell of known types that are no members.
    """
    groups = taxonomies.select(F.col("taxonomy_name").alias("category"), F.transform("members", F.lower).alias("_ms"), F.transform("defining_rels", F.lower).alias("_rels"), F.lit(True).alias("_known"))
    met = edges.join(groups, "category", "left")
    advice = F.when(F.coalesce("category", F.lit("")) == "", "no_category").when(F.col("_known").isNull(), "unknown_category").when(F.coalesce(F.array_contains("_rels", F.lower("rel_type")), F.lit(False)), "checked").otherwise("other_relation")
    outside = lambda c: (advice == "checked") & (F.coalesce(F.size("_ms"), F.lit(0)) > 0) & F.coalesce((F.lower(c) != "unknown") & ~F.array_contains("_ms", F.lower(c)), F.lit(False))
    return met.select(*edges.columns, advice.alias("advice"), outside("subject_type").alias("subject_outside"), outside("object_type").alias("object_outside"))
