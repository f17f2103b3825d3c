"""Pattern extraction, property names, claimed values, taxonomy arrays and nesting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import extraction, graphs
from factloom.plans.filter_queries import _list, _said_sql, said
from factloom.plans.registry import register
from factloom.sources import driver_tables as src
from factloom.sources import readers

TOLD = [
    "My name is Ada and I am 42",
    "Robert goes by Bob, and a dog named Rex is here",
    "my wife Clara and my daughter Dora",
    "Eve is 7. my son frank",
    "hostname is web-01; Gina works for Acme",
    "sorry, Hal deals with Ivy",
    "the it named Foo, my name is a",
    "nothing to see",
    "Jo works for Ko. Jo works for Ko. Li works with Mo",
]


def _edge_sql(place: int, rel: str, pattern: str, groups: int) -> str:
    word = lambda c: f"(length({c}) > 1 AND NOT list_contains({_list(extraction.STOPWORDS)}, lower({c})))"
    named = lambda c: f"({word(c)} AND regexp_matches({c}, '^[A-Z]'))"
    if rel in ("also_known_as", "pref_name"):
        s, o, good = ("'user'", "a", word("a")) if groups == 1 else ("a", "b", f"{word('a')} AND {word('b')}")
    elif rel in ("spouse", "parent_of"):
        s, o, good = "'user'", "a", named("a")
    elif rel == "age":
        s, o, good = ("'user'", "a", "true") if groups == 1 else ("a", "b", named("a"))
    else:
        s, o, good = ("'system'", "a", "length(a) > 1") if groups == 1 else ("a", "b", "length(a) > 1 AND length(b) > 1")
    return f"SELECT key, text, {place} AS place, '{rel}' AS rel_type, lower({s}) AS subject, lower({o}) AS object FROM (SELECT key, text, unnest(regexp_extract_all(text, '{pattern}', 1)) AS a, unnest(regexp_extract_all(text, '{pattern}', {groups})) AS b FROM s) WHERE {good}"


RANK = "CASE rel_type " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in extraction.PRIORITY.items()) + " ELSE 0 END"


@register(
    "pattern_facts",
    f"""WITH {_said_sql(TOLD)}, e AS ({' UNION ALL '.join(_edge_sql(i, *p) for i, p in enumerate(extraction.PATTERNS))})
    SELECT key, subject, object, arg_min(rel_type, (-({RANK}), place)) AS rel_type, bool_or(regexp_matches(lower(text), '{'|'.join(extraction.CORRECTIONS)}')) AS is_correction, arg_min(rel_type, (-({RANK}), place)) = 'pref_name' AS is_preferred_label FROM e GROUP BY key, subject, object""",
)
def pattern_facts(spark, folder):
    return extraction.extract(said(spark, folder, TOLD))


@register("pattern_table_facts")
def pattern_table_facts(spark, folder):
    """What the long words of the benchmark are followed by in documents, from a table with a pattern for each of them; some rows do not compile, are of scalars or not active."""
    words = src.table(spark, folder, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 11").distinct()
    number = F.crc32(F.col("w").cast("binary")) % 10
    table = words.select(
        F.concat(F.lit("before_"), "w").alias("rel_type"), F.when(number == 0, F.concat("w", F.lit("("))).otherwise(F.concat(F.lit(r"\b("), "w", F.lit(r") ([a-z]+)\b"))).alias("pattern_regex"),
        (F.length("w") / 100.0).alias("global_confidence"), F.when(number == 1, "scalar_atomic").otherwise("compound").alias("category"), (number != 2).alias("is_active"),
    )
    return extraction.extract(src.table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text"), readers.patterns(table))


NAMES = ["Hostname", " internal IP ", "the boot disk", "colour", "CPU", "main memory", "os version", "certificate end"]


def _property_sql(text: str) -> str:
    exact = " ".join(f"WHEN lower(trim({text})) = '{k}' THEN '{r}'" for k, r in extraction.PROPERTIES.items())
    within = " ".join(f"WHEN contains(lower(trim({text})), '{k}') THEN '{r}'" for k, r in extraction.PROPERTIES.items())
    return f"CASE {exact} {within} ELSE 'related_to' END"


@register("property_relations", f"WITH {_said_sql(NAMES)} SELECT key, {_property_sql('text')} AS rel_type FROM s")
def property_relations(spark, folder):
    return said(spark, folder, NAMES).select("key", extraction.property_relation(F.col("text")).alias("rel_type"))


@register(
    "unclaimed_edges",
    """WITH e AS (SELECT l_orderkey AS key, l_returnflag AS rel_type, CAST(l_quantity AS INT) AS object FROM lineitem), c AS (SELECT l_orderkey AS key, l_returnflag AS rel_type, CAST(l_quantity AS INT) AS value FROM lineitem WHERE l_linenumber = 1)
    SELECT key, rel_type, object, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = e.key AND c.value = e.object) OR EXISTS (SELECT 1 FROM c WHERE c.key = e.key AND c.value = e.object AND c.rel_type = e.rel_type) GROUP BY ALL""",
)
def unclaimed_edges(spark, folder):
    """Lines of an order whose quantity is not that of its first line under another flag."""
    rows = src.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("rel_type"), F.col("l_quantity").cast("int").alias("object"), "l_linenumber")
    claims = rows.where("l_linenumber = 1").select("key", "rel_type", F.col("object").alias("value"))
    return extraction.unclaimed_counts(rows, claims)


@register(
    "taxonomy_nesting",
    """WITH RECURSIVE t AS (SELECT 'r' || n_regionkey AS family, list_sort(list(DISTINCT 'n' || n_nationkey)) AS members FROM nation GROUP BY 1 UNION ALL SELECT 'world', list_sort(list(DISTINCT 'r' || r_regionkey)) FROM region),
        severed AS (SELECT 'world' AS family, 'r0' AS member UNION ALL SELECT 'r1', 'n1'),
        m AS (SELECT family, unnest(members) AS member FROM t), e AS (SELECT * FROM m WHERE (family, member) NOT IN (SELECT family, member FROM severed)),
        d(root, member, depth) AS (SELECT family, member, 1 FROM e UNION ALL SELECT d.root, e.member, d.depth + 1 FROM d JOIN e ON e.family = d.member)
    SELECT root, member, min(depth) AS depth FROM d GROUP BY ALL""",
)
def taxonomy_nesting(spark, folder):
    """All members below each family, without those that were severed and what hung on them."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nations = src.table(spark, folder, "nation").select(name("r", "n_regionkey").alias("family"), name("n", "n_nationkey").alias("member"))
    regions = src.table(spark, folder, "region").select(F.lit("world").alias("family"), name("r", "r_regionkey").alias("member"))
    edges = nations.union(regions).distinct()
    severed = spark.createDataFrame([("world", "r0"), ("r1", "n1")], "family string, member string")
    return graphs.nested_members(edges, severed)


@register(
    "taxonomy_arrays",
    """WITH t AS (SELECT n_regionkey AS region, list(DISTINCT n_name) AS names FROM nation GROUP BY 1), f AS (SELECT region, min(n_name) AS gone FROM t JOIN nation ON n_regionkey = region GROUP BY 1)
    SELECT region, array_to_string(list_sort(list_filter(names, lambda x: x <> gone)), ',') AS removed, array_to_string(list_sort(list_distinct(list_append(names, 'EXTRA'))), ',') AS appended, array_to_string(list_sort(list_filter(names, lambda x: length(x) <> 5)), ',') AS rebuilt FROM t JOIN f USING (region)""",
)
def taxonomy_arrays(spark, folder):
    """A member removed from, appended to and excepted from an array of members."""
    t = src.table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_set("n_name").alias("names"), F.min("n_name").alias("gone"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    five = F.filter("names", lambda x: F.length(x) == 5)
    return t.select("region", joined(F.array_remove("names", F.col("gone"))).alias("removed"), joined(F.array_distinct(F.array_append("names", F.lit("EXTRA")))).alias("appended"), joined(F.array_except("names", five)).alias("rebuilt"))


@register("distinct_types", f"WITH {src.ENTITY_TYPES} SELECT DISTINCT lower(entity_type) AS entity_type FROM entity_types WHERE entity_type <> 'unknown'")
def distinct_types(spark, folder):
    """The types that entities have, lowered."""
    return src.entity_types(spark, folder).where("entity_type <> 'unknown'").select(F.lower("entity_type").alias("entity_type")).distinct()


@register(
    "alias_relations",
    """WITH a AS (SELECT upper(p_brand) AS alias, lower(p_type) AS canonical FROM part), r AS (SELECT DISTINCT titled AS rel_type FROM (SELECT upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS titled FROM part))
    SELECT alias, rel_type, count(*) AS n FROM a JOIN r ON lower(a.canonical) = lower(r.rel_type) GROUP BY ALL""",
)
def alias_relations(spark, folder):
    """Aliases joined to relations whatever their case."""
    part = src.table(spark, folder, "part")
    aliases = part.select(F.upper("p_brand").alias("alias"), F.lower("p_type").alias("key"))
    title = F.concat(F.upper(F.left("p_type", F.lit(1))), F.lower(F.substr("p_type", F.lit(2))))
    rels = part.select(title.alias("rel_type")).distinct().withColumn("key", F.lower("rel_type"))
    return aliases.join(rels, "key").groupBy("alias", "rel_type").agg(F.count("*").alias("n"))


@register(
    "nth_events",
    f"""WITH {src.ASSERTIONS}, d AS (SELECT subject, id, CASE WHEN id % 10 = 0 THEN NULL ELSE ts END AS moment FROM assertions),
        n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY moment NULLS LAST, id) AS up, row_number() OVER (PARTITION BY subject ORDER BY moment DESC NULLS LAST, id) AS down FROM d)
    SELECT subject, max(id) FILTER (up = 1) AS first_id, max(id) FILTER (down = 1) AS last_id, max(id) FILTER (up = 3) AS third_id FROM n GROUP BY subject""",
)
def nth_events(spark, folder):
    """The first, last and third event of each subject, dated ones before those without a date."""
    rows = src.assertions(spark, folder).select("subject", "id", F.when(F.col("id") % 10 != 0, F.col("ts")).alias("at"))
    dated = F.col("at").isNotNull()
    first = F.coalesce(F.min_by("id", F.when(dated, F.struct("at", "id"))), F.min("id"))
    last = F.coalesce(F.max_by("id", F.when(dated, F.struct("at", -F.col("id")))), F.min("id"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.col("at").asc_nulls_last(), "id"))
    third = rows.withColumn("place", place).where("place = 3").select("subject", F.col("id").alias("third_id"))
    return rows.groupBy("subject").agg(first.alias("first_id"), last.alias("last_id")).join(third, "subject", "left")
