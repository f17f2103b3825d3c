"""Scans and sinks of the graph's tables.

A tenant is a partition column with a filter that reaches the scan; the ontology
comes from the tenant's rows, and from the seed only without a tenant.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.dates import union_of

MOST_PATTERNS = 10_000

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def of_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    return rows.where(F.col("tenant_id") == tenant)


def ontology(rows: DataFrame, tenant: str | None) -> DataFrame:
    """The tenant's relation types, or the seed's (null tenant) if none is bound."""
    return rows.where(F.col("tenant_id").isNull()) if tenant is None else of_tenant(rows, tenant)


def cues(rows: DataFrame, category: str) -> DataFrame:
    """Active cues of a category, each once."""
    return rows.where((F.col("category") == category) & F.col("is_active")).select("cue").distinct()


def keyed_cues(rows: DataFrame, category: str) -> DataFrame:
    """(cue, description) of active cues, blank descriptions dropped; the least of several."""
    kept = rows.where((F.col("category") == category) & F.col("is_active") & (F.trim(F.coalesce("description", F.lit(""))) != ""))
    return kept.groupBy("cue").agg(F.min("description").alias("description"))


def surfaces(rows: DataFrame) -> DataFrame:
    """All active cues of whatever category, lowered, each once."""
    return rows.where("is_active").select(F.lower(F.trim("cue")).alias("cue")).where("cue <> ''").distinct()


def relative_cues(patterns: DataFrame) -> DataFrame:
    """The active date patterns that are relative to now, surest first."""
    return patterns.where("is_active and anchor_type = 'relative'").orderBy(F.desc("global_confidence"), "pattern_regex").select("pattern_regex", "anchor_type")


def patterns(table: DataFrame, categories: list[str] | None = None, without: list[str] = ["scalar_atomic"]) -> list[tuple[str, str, int]]:  # noqa: B006
    """(rel_type, pattern, groups) of a pattern table's active rows, surest first, those that do not compile left out.

    A pattern table is a lexicon that its maintainers write; one of more than
    ``MOST_PATTERNS`` rows is refused.  A row without a category is of none of
    the categories.
    """
    rows = table.where("is_active")
    rows = rows.where(F.col("category").isin(categories)) if categories is not None else rows.where(F.coalesce(~F.col("category").isin(without), F.lit(True)))
    found = rows.select("rel_type", "pattern_regex", "global_confidence").limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    kept = []
    for r in sorted(found, key=lambda r: (-(r.global_confidence or 0.0), r.pattern_regex or "", r.rel_type or "")):
        try:
            kept.append((r.rel_type, r.pattern_regex, re.compile(r.pattern_regex).groups))
        except (re.error, TypeError):
            continue
    return kept


def matcher(table: DataFrame, category: str) -> str:
    """One pattern of all active ones of a category; it matches nothing if there is none."""
    return union_of([p for _, p, _ in patterns(table, [category])])


def seed_missing(seed: DataFrame, tenant: DataFrame, key: list[str]) -> DataFrame:
    """The tenant's rows and those of the seed that it lacks."""
    return tenant.unionByName(seed.join(tenant.select(*key), key, "left_anti"), allowMissingColumns=True)


def oldest(queue: DataFrame, status: str, n: int) -> DataFrame:
    """The n oldest entries of a queue with a status: a top-k by design."""
    return queue.where(F.col("status") == status).orderBy("created_at", "id").limit(n)


def parsed(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON of a column as a struct, null where it does not parse."""
    return lines.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only sink of logs."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
