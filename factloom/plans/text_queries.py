"""Text operators over documents, and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import rendering, texts
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

SENTENCES = """sentences AS (
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS position, unnest(parts) AS sentence FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents))"""


def sentence_rows(spark, folder):
    docs = src.table(spark, folder, "documents")
    return docs.select("doc_id", F.posexplode(texts.sentences(F.col("text"))).alias("position", "sentence"))


@register("sentence_split", f"WITH {SENTENCES} SELECT doc_id, CAST(position AS BIGINT) AS position, sentence FROM sentences")
def sentence_split(spark, folder):
    return sentence_rows(spark, folder).withColumn("position", F.col("position").cast("long"))


PARTS = "list_filter(list_transform(string_split(regexp_replace({p}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
OPEN = "{{'done': CAST([] AS VARCHAR[]), 'o': {o}, 'n': {n}}}"


def _gathered_sql(items: str, joiner: str, fits: str) -> str:
    step = f"CASE WHEN {fits} THEN {{'done': a.done, 'o': a.o || {joiner} || x.o, 'n': a.n + x.n}} ELSE {{'done': list_append(a.done, a.o), 'o': x.o, 'n': x.n}} END"
    return f"list_reduce({items}, lambda a, x: {step})"


CUT = _gathered_sql(f"list_transform({PARTS.format(p='p')}, lambda t: {OPEN.format(o='t', n='CAST(1 AS BIGINT)')})", "' '", "a.n < 6 AND length(a.o) + length(x.o) + 2 <= 1200")
HELD = f"greatest(CAST(1 AS BIGINT), len({PARTS.format(p='t')}))"


@register(
    "chunk_documents",
    f"""WITH p AS (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents
    ), c AS (
        SELECT doc_id, i, CASE WHEN length(p) <= 1200 THEN {{'done': CAST([] AS VARCHAR[]), 'o': p, 'n': CAST(1 AS BIGINT)}} ELSE {CUT} END AS cut FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM p)
    ), q AS (
        SELECT doc_id, flatten(list(list_append(cut.done, cut.o) ORDER BY i)) AS pieces FROM c GROUP BY doc_id
    ), m AS (
        SELECT doc_id, {_gathered_sql(f"list_transform(pieces, lambda t: {OPEN.format(o='t', n=HELD)})", "chr(10) || chr(10)", "a.n < 2 AND a.n + x.n <= 6 AND length(a.o) + length(x.o) + 4 <= 1200")} AS r FROM q
    ), k AS (
        SELECT doc_id, list_append(r.done, r.o) AS chunks FROM m
    ) SELECT doc_id, generate_subscripts(chunks, 1) > 200 AS truncated, generate_subscripts(chunks, 1) - 1 AS position, unnest(chunks) AS chunk FROM k""",
)
def chunk_documents(spark, folder):
    return texts.chunks(src.table(spark, folder, "documents"))


def _scalar_sql(kind: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{texts.SCALARS[kind]}')) AS value FROM documents"


@register("extract_emails", f"SELECT doc_id, kind, value, count(*) AS n FROM ({_scalar_sql('email')}) GROUP BY ALL")
def extract_emails(spark, folder):
    return texts.scalars(src.table(spark, folder, "documents"), {"email": texts.SCALARS["email"]})


@register("atomic_scalars", f"SELECT doc_id, kind, value, count(*) AS n FROM ({' UNION ALL '.join(map(_scalar_sql, texts.SCALARS))}) GROUP BY ALL")
def atomic_scalars(spark, folder):
    return texts.scalars(src.table(spark, folder, "documents"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"


@register(
    "content_token_diff",
    f"""SELECT a.p_partkey, array_to_string(list_sort(list_filter({WORDS.format(c="a.p_name")}, lambda w: NOT list_contains({WORDS.format(c="b.p_name")}, w))), ' ') AS invented
    FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
)
def content_token_diff(spark, folder):
    part = src.table(spark, folder, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("source"))
    return part.join(other, "p_partkey").select("p_partkey", F.array_join(texts.invented(F.col("p_name"), F.col("source")), " ").alias("invented"))


@register(
    "ordered_dedup",
    """WITH w AS (SELECT item_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark))
    SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item_id, lower(w) ORDER BY i) = 1) GROUP BY item_id""",
)
def ordered_dedup(spark, folder):
    return src.table(spark, folder, "benchmark").select("item_id", F.array_join(texts.ordered_distinct(F.split("text", " ")), " ").alias("words"))


@register(
    "uuid5_surrogate",
    """WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(lower(trim(c_name)))) AS h FROM customer)
    SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS entity_id FROM h""",
)
def uuid5_surrogate(spark, folder):
    name = F.lower(F.trim("c_name"))
    return src.table(spark, folder, "customer").select("c_custkey", texts.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", name).alias("entity_id"))


@register("fingerprint_sha256", "SELECT event_id, sha256(concat_ws(chr(31), user_id, event_type, props)) AS fingerprint, left(sha256(concat_ws(chr(31), user_id, event_type)), 16) AS cache_key FROM events")
def fingerprint_sha256(spark, folder):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    return src.table(spark, folder, "events").select("event_id", texts.fingerprint(user, kind, F.col("props")).alias("fingerprint"), F.left(texts.fingerprint(user, kind), F.lit(16)).alias("cache_key"))


@register("normalize_relation", "SELECT p_partkey, regexp_replace(trim(regexp_replace(lower('is the ' || p_name), '[^a-z0-9]+', ' ', 'g')), '^((the|a|an|is|are) )+', '') AS words, replace(regexp_replace(trim(regexp_replace(lower('is the ' || p_name), '[^a-z0-9]+', ' ', 'g')), '^((the|a|an|is|are) )+', ''), ' ', '_') AS relation FROM part")
def normalize_relation(spark, folder):
    named = texts.relation_name(F.concat(F.lit("is the "), "p_name"))
    return src.table(spark, folder, "part").select("p_partkey", F.replace(named, F.lit("_"), F.lit(" ")).alias("words"), named.alias("relation"))


FLAT = "regexp_replace(regexp_replace(regexp_replace(lower('The ' || p_name), '[-_]+', ' ', 'g'), '''s\\b', '', 'g'), '[^a-z0-9 ]', '', 'g')"


@register(
    "synonym_key",
    f"""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array({FLAT}, '\\s+'), lambda w: w <> '') AS ws FROM part)
    SELECT p_partkey, array_to_string(CASE WHEN len(ws) > 1 AND list_contains({texts.ARTICLES}, ws[1]) THEN ws[2:] ELSE ws END, ' ') AS key FROM w""",
)
def synonym_key(spark, folder):
    return src.table(spark, folder, "part").select("p_partkey", texts.synonym_key(F.concat(F.lit("The "), "p_name")).alias("key"))


@register(
    "unmatched_sentences",
    f"""WITH {SENTENCES}, t AS (SELECT doc_id, lower(split_part(text, ' ', 1)) AS term FROM documents)
    SELECT s.doc_id, CAST(position AS BIGINT) AS position, sentence FROM sentences s JOIN t USING (doc_id)
    WHERE NOT contains(lower(sentence), term) AND len(regexp_split_to_array(trim(sentence), '\\s+')) >= 4""",
)
def unmatched_sentences(spark, folder):
    terms = src.table(spark, folder, "documents").select("doc_id", F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("term"))
    return texts.unmatched(sentence_rows(spark, folder).withColumn("position", F.col("position").cast("long")), terms)


@register(
    "render_templates",
    f"""WITH {src.ASSERTIONS}, {src.REL_TYPES} SELECT id, CASE WHEN template IS NULL THEN who || ' ' || replace(a.rel_type, '_', ' ') || ' ' || object ELSE replace(replace(template, '{{x}}', who), '{{y}}', object) END
        || CASE WHEN id % 2 = 0 THEN ' (on ' || strftime(ts, '%Y-%m-%d') || ')' ELSE '' END AS text
    FROM (SELECT *, CASE WHEN subject = 'user:1' THEN 'you' ELSE subject END AS who FROM assertions) a LEFT JOIN rel_types USING (rel_type)""",
)
def render_templates(spark, folder):
    rows = src.assertions(spark, folder).join(src.rel_types(spark), "rel_type", "left")
    who = rendering.display_name(F.col("subject"), F.lit(None), F.lit("user:1"))
    text = rendering.sentence(F.col("template"), F.col("rel_type"), who, F.col("object"))
    return rows.select("id", rendering.dated(text, F.when(F.col("id") % 2 == 0, F.to_date("ts"))).alias("text"))


@register(
    "article_and_negation",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^[A-Z0-9]{2,}$') THEN CASE WHEN regexp_matches(p_type, '^[AEFHILMNORSX8]') THEN 'an' ELSE 'a' END
            WHEN regexp_matches(lower(p_type), '^[aeiou]') THEN 'an' ELSE 'a' END AS article,
        'it is not the case that ' || p_name AS negated, p_name || ' is not here' AS negated_is FROM part""",
)
def article_and_negation(spark, folder):
    part = src.table(spark, folder, "part")
    return part.select("p_partkey", rendering.article(F.col("p_type")).alias("article"), rendering.negated(F.col("p_name")).alias("negated"), rendering.negated(F.concat("p_name", F.lit(" is here"))).alias("negated_is"))


@register(
    "recall_block",
    f"""WITH {src.ASSERTIONS}, {src.REL_TYPES}, t AS (
        SELECT subject, CASE WHEN template IS NULL THEN subject || ' ' || replace(a.rel_type, '_', ' ') || ' ' || object ELSE replace(replace(template, '{{x}}', subject), '{{y}}', object) END AS text, fact_class, confidence FROM assertions a LEFT JOIN rel_types USING (rel_type)
    ), b AS (
        SELECT subject, text, bool_and(coalesce(upper(fact_class) = 'C', false)) AS tentative, max(confidence) AS confidence FROM t WHERE text <> '' GROUP BY ALL
    ) SELECT subject, coalesce(nullif(concat_ws(chr(10), string_agg('- ' || text, chr(10) ORDER BY confidence DESC NULLS LAST, text) FILTER (NOT tentative),
        'Perhaps:' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY confidence DESC NULLS LAST, text) FILTER (tentative)), ''), 'Nothing known.') AS block FROM b GROUP BY subject""",
)
def recall_block(spark, folder):
    rows = src.assertions(spark, folder).join(src.rel_types(spark), "rel_type", "left")
    text = rendering.sentence(F.col("template"), F.col("rel_type"), F.col("subject"), F.col("object"))
    return rendering.recall(rows.select("subject", text.alias("text"), "fact_class", "confidence"), "subject")
