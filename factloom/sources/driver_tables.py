"""The driver tables as a knowledge graph: entities, edges, assertions and attributes.

Each view is given twice, as a DataFrame and as the SQL that DuckDB runs, so
that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed list of rows as a table whose size Spark knows, so that a join with it shuffles nothing."""
    names = [column.split()[0] for column in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: [row[i] for row in rows] for i, name in enumerate(names)}), schema)


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """subject, rel_type, object: where a customer, supplier or nation lies."""
    read = lambda name: table(spark, folder, name)
    edge = lambda df, s, o: df.select(s.alias("subject"), F.lit("located_in").alias("rel_type"), o.alias("object"))
    return (
        edge(read("nation"), _key("nation", "n_nationkey"), _key("region", "n_regionkey"))
        .unionByName(edge(read("customer"), _key("customer", "c_custkey"), _key("nation", "c_nationkey")))
        .unionByName(edge(read("supplier"), _key("supplier", "s_suppkey"), _key("nation", "s_nationkey")))
    )


HIERARCHY = """hierarchy AS (
    SELECT 'nation:' || n_nationkey AS subject, 'located_in' AS rel_type, 'region:' || n_regionkey AS object FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey FROM supplier
)"""


def entity_types(spark: SparkSession, folder: str) -> DataFrame:
    """entity_id, entity_type; suppliers are of unknown type."""
    read = lambda name: table(spark, folder, name)
    one = lambda df, key, kind: df.select(key.alias("entity_id"), F.lit(kind).alias("entity_type"))
    return (
        one(read("region"), _key("region", "r_regionkey"), "Region")
        .unionByName(one(read("nation"), _key("nation", "n_nationkey"), "Location"))
        .unionByName(one(read("customer"), _key("customer", "c_custkey"), "Organization"))
        .unionByName(one(read("supplier"), _key("supplier", "s_suppkey"), "unknown"))
        .unionByName(one(read("part"), _key("part", "p_partkey"), "Object"))
    )


ENTITY_TYPES = """entity_types AS (
    SELECT 'region:' || r_regionkey AS entity_id, 'Region' AS entity_type FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'Location' FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'Organization' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'unknown' FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, 'Object' FROM part
)"""


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """subject, rel_type, object: which supplier supplies which part, each once."""
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()  # by their numbers, which are shorter than their names
    return pairs.select(_key("supplier", "l_suppkey").alias("subject"), F.lit("supplies").alias("rel_type"), _key("part", "l_partkey").alias("object"))


RELATIONS = """relations AS (
    SELECT DISTINCT 'supplier:' || l_suppkey AS subject, 'supplies' AS rel_type, 'part:' || l_partkey AS object FROM lineitem
)"""


def assertions(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated, timed assertions: a user's event of a type about the key of its JSON properties."""
    case = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        _key("user", "user_id").alias("subject"),
        F.col("event_type").alias("rel_type"),
        F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("object"),
        "ts",
        ((F.col("event_id") % 11).cast("double") / 10).alias("confidence"),
        case("C", "B", "A", "B", "C").alias("fact_class"),
        case("llm_inferred", "llm_inferred", "user_stated", "llm_inferred").alias("provenance"),
        "value",
    )


ASSERTIONS = """assertions AS (
    SELECT event_id AS id, 'user:' || user_id AS subject, event_type AS rel_type, 'k:' || json_extract_string(props, '$.k') AS object, ts,
           CAST(event_id % 11 AS DOUBLE) / 10 AS confidence,
           ['C', 'B', 'A', 'B', 'C'][event_id % 5 + 1] AS fact_class,
           ['llm_inferred', 'llm_inferred', 'user_stated', 'llm_inferred'][event_id % 4 + 1] AS provenance, value
    FROM events
)"""


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    """entity_id, attribute, value_text, value_float: scalar facts, one row per entity and attribute."""
    customer = table(spark, folder, "customer")
    part = table(spark, folder, "part")
    return customer.select(
        _key("customer", "c_custkey").alias("entity_id"),
        F.expr("stack(2, 'account_balance', cast(null as string), c_acctbal, 'market_segment', c_mktsegment, cast(null as double)) as (attribute, value_text, value_float)"),
    ).unionByName(
        part.select(
            _key("part", "p_partkey").alias("entity_id"),
            F.expr("stack(2, 'retail_price', cast(null as string), p_retailprice, 'size', cast(p_size as string), cast(p_size as double)) as (attribute, value_text, value_float)"),
        )
    )


ATTRIBUTES = """attributes AS (
    SELECT 'customer:' || c_custkey AS entity_id, 'account_balance' AS attribute, CAST(NULL AS VARCHAR) AS value_text, c_acctbal AS value_float FROM customer
    UNION ALL SELECT 'customer:' || c_custkey, 'market_segment', c_mktsegment, NULL FROM customer
    UNION ALL SELECT 'part:' || p_partkey, 'retail_price', NULL, p_retailprice FROM part
    UNION ALL SELECT 'part:' || p_partkey, 'size', CAST(p_size AS VARCHAR), CAST(p_size AS DOUBLE) FROM part
)"""


def rel_types(spark: SparkSession) -> DataFrame:
    """The ontology: what each relation may join, and how it behaves."""
    rows = [
        ("located_in", ["Organization", "Location"], ["Location", "Region"], False, None, True, "{x} is in {y}"),
        ("supplies", ["Organization"], ["Object"], False, "supplied_by", False, "{x} supplies {y}"),
        ("knows", ["Person"], ["Person"], True, "knows", False, None),
        ("error", ["ANY"], ["ANY"], False, None, False, None),
        ("view", ["Person"], ["SCALAR"], False, None, False, "{x} viewed {y}"),
    ]
    schema = "rel_type string, head_types array<string>, tail_types array<string>, is_symmetric boolean, inverse_rel_type string, is_hierarchy_rel boolean, template string"
    return listed(spark, rows, schema)


REL_TYPES = """rel_types AS (
    SELECT * FROM (VALUES
        ('located_in', ['Organization', 'Location'], ['Location', 'Region'], false, NULL, true, '{x} is in {y}'),
        ('supplies', ['Organization'], ['Object'], false, 'supplied_by', false, '{x} supplies {y}'),
        ('knows', ['Person'], ['Person'], true, 'knows', false, NULL),
        ('error', ['ANY'], ['ANY'], false, NULL, false, NULL),
        ('view', ['Person'], ['SCALAR'], false, NULL, false, '{x} viewed {y}')
    ) AS t(rel_type, head_types, tail_types, is_symmetric, inverse_rel_type, is_hierarchy_rel, template)
)"""
