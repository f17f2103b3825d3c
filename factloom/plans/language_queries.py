"""Relation phrases, phrases of a lexicon, and edges read from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import lifts, mentions, morphology, phrases
from factloom.plans.registry import register
from factloom.plans.text_queries import SENTENCES
from factloom.sources import driver_tables as src


def quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _map(pairs) -> str:
    return f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in pairs.items())}}}"


REGULAR = """(CASE WHEN len({w}) > 4 AND {w} LIKE '%ing' THEN {ing} WHEN len({w}) > 4 AND {w} LIKE '%ied' THEN {w}[:-4] || 'y' WHEN len({w}) > 3 AND {w} LIKE '%ed' THEN {ed}
    WHEN len({w}) > 3 AND {w} LIKE '%ies' THEN {w}[:-4] || 'y' WHEN len({w}) > 4 AND ({w} LIKE '%ches' OR {w} LIKE '%shes' OR {w} LIKE '%xes' OR {w} LIKE '%zes' OR {w} LIKE '%oes') THEN {w}[:-3]
    WHEN len({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:-2] ELSE {w} END)"""
STEM = """({s} || CASE WHEN len({s}) < 3 THEN '' WHEN {s} LIKE '%l' AND {s} NOT LIKE '%ll' OR {s}[-1] IN ('v', 'z', 'u') OR {s}[-1] IN ('c', 'g', 's') AND {s}[-2] IN ('a', 'e', 'i', 'o', 'u')
    OR {s} LIKE '%at' AND {s} NOT LIKE '%eat' THEN 'e' ELSE '' END)"""


def regular_sql(w: str) -> str:
    return REGULAR.format(w=w, ing=STEM.format(s=f"{w}[:-4]"), ed=STEM.format(s=f"{w}[:-3]"))


def lemma_sql(w: str) -> str:
    return f"coalesce(({_map(morphology.IRREGULAR)})[{w}], {regular_sql(w)})"


def normal_sql(given: str, name: str, phrase: str = "phrase") -> str:
    """CTEs that take ``phrase`` of ``given`` to ``normal`` in ``name``, by distinct phrases."""
    prep, aux, det = quoted(morphology.PREPOSITIONS), quoted(morphology.AUXILIARY_WORDS), quoted(morphology.DETERMINERS)
    return f"""{name}_a AS (
        SELECT DISTINCT {phrase} AS phrase, list_transform(list_filter(regexp_extract_all(lower({phrase}), '[a-z0-9]+'), lambda t: t NOT IN ('s', 't', 're', 'm')), lambda t: CASE t WHEN 've' THEN 'have' WHEN 'll' THEN 'will' WHEN 'd' THEN 'had' ELSE t END) AS ws FROM {given}
    ), {name}_b AS (
        SELECT *, list_position(list_transform(ws, lambda t: NOT list_contains({quoted(morphology.LEADING_WORDS)}, t)), true) AS i FROM {name}_a
    ), {name}_c AS (
        SELECT *, ws[i:] AS us FROM {name}_b
    ), {name}_d AS (
        SELECT *, us[coalesce(nullif(list_position(list_transform(us, lambda t: NOT (list_contains({aux}, t) AND t NOT IN ('have', 'has', 'had', 'do', 'does', 'did'))), true), 0), len(us)):] AS vs FROM {name}_c
    ), {name}_e AS (
        SELECT *, {lemma_sql('vs[1]')} AS head, list_filter(vs[2:], lambda t: NOT list_contains({det}, t) AND NOT list_contains({aux}, t) AND NOT list_contains({prep}, t))[1] AS noun,
            list_transform(list_filter(vs[2:], lambda t: list_contains({prep}, t) OR NOT (list_contains({det}, t) OR list_contains({aux}, t))), lambda t: CASE WHEN list_contains({prep}, t) THEN t ELSE {lemma_sql('t')} END) AS tail FROM {name}_d
    ), {name}_f AS (
        SELECT *, ({_map(morphology.LIGHT_VERBS)})[head] AS light FROM {name}_e
    ), {name} AS (
        SELECT phrase, CASE WHEN len(ws) = 0 THEN '' WHEN i IS NULL OR i = 0 THEN {regular_sql('ws[-1]')} WHEN light IS NOT NULL THEN light || CASE WHEN noun IS NULL THEN '' ELSE '_' || {lemma_sql('noun')} END
            WHEN len(tail) = 0 AND head IN ('ve', 'll', 'd', 's', 't', 're', 'm') THEN '' ELSE array_to_string(list_concat([head], tail), '_') END AS normal FROM {name}_f
    )"""


WORDS_OF = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
THREE = f"""runs AS (
    SELECT DISTINCT ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS phrase FROM (SELECT ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM (SELECT {WORDS_OF} AS ws FROM conversations))
)"""


def word_runs(spark, folder):
    """Every run of three words that is said in a conversation, once."""
    ws = F.col("ws")
    rows = src.table(spark, folder, "conversations").select(phrases.words(F.col("text")).alias("ws")).where("size(ws) >= 3")
    runs = F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.array_join(F.slice(ws, i, 3), " "))
    return rows.select(F.explode(runs).alias("phrase")).distinct()


@register("relation_normal_form", f"WITH {THREE}, {normal_sql('runs', 'found')} SELECT phrase, normal FROM found")
def relation_normal_form(spark, folder):
    return word_runs(spark, folder).select("phrase", morphology.normal_form(F.col("phrase")).alias("normal"))


SEEDED = """seeded AS (
    SELECT DISTINCT {w} AS rel_type FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE len(w) BETWEEN 4 AND 12
)"""


def seeded_words(spark, folder):
    """The words of the benchmark that stand for seeded relations."""
    words = src.table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("rel_type"))
    return words.where("length(rel_type) between 4 and 12").distinct()


@register(
    "fold_onto_seeded",
    f"""WITH {SEEDED.format(w='w')}, heard AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS phrase FROM conversations), {normal_sql('heard', 'a')}, {normal_sql('seeded', 'b', 'rel_type')},
    t AS (SELECT normal, min(phrase) AS rel_type FROM b WHERE normal <> '' GROUP BY normal)
    SELECT a.phrase AS surface, a.normal, CASE WHEN t.rel_type <> a.phrase THEN t.rel_type END AS rel_type FROM a LEFT JOIN t ON t.normal = a.normal""",
)
def fold_onto_seeded(spark, folder):
    heard = src.table(spark, folder, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("surface")).distinct()
    return morphology.fold_onto_seeded(heard, seeded_words(spark, folder))


LEXICON = """lexicon AS (
    SELECT DISTINCT array_to_string(ws[i:i + n - 1], ' ') AS phrase, n FROM (SELECT ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM benchmark), (VALUES (1), (2), (4)) AS l(n))
    WHERE n > 1 OR len(ws[i]) >= 9
)"""


def lexicon(spark, folder):
    """Phrases of one long word, two words and four words that the benchmark has."""
    ws = F.col("ws")
    rows = src.table(spark, folder, "benchmark").select(phrases.words(F.col("text")).alias("ws")).select("ws", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("n")).where("size(ws) >= n")
    found = rows.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.array_join(F.slice(ws, i, F.col("n")), " "))).alias("phrase"))
    return found.where("n > 1 or length(phrase) >= 9").select("phrase").distinct()


SPANS = """spans AS (
    SELECT r.key, phrase, "at", r.n FROM (
        SELECT key, n, unnest(generate_series(0, len(ws) - n)) AS "at", ws FROM (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents), (VALUES (1), (2), (4)) AS l(n)
    ) r JOIN lexicon l ON l.n = r.n AND l.phrase = array_to_string(r.ws["at" + 1:"at" + r.n], ' ')
)"""


def document_spans(spark, folder):
    return phrases.phrase_spans(src.table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text"), lexicon(spark, folder))


@register("phrase_spans", f'WITH {LEXICON}, {SPANS} SELECT key, phrase, "at", n FROM spans')
def phrase_spans(spark, folder):
    return document_spans(spark, folder)


@register(
    "merged_phrase_spans",
    f"""WITH {LEXICON}, {SPANS}, p AS (
        SELECT *, max("at" + n) OVER (PARTITION BY key ORDER BY "at", n, phrase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans
    ), g AS (
        SELECT *, count(*) FILTER (reach IS NULL OR reach < "at") OVER (PARTITION BY key ORDER BY "at", n, phrase ROWS UNBOUNDED PRECEDING) AS grp FROM p
    ) SELECT key, min("at") AS "at", max("at" + n) - min("at") AS n, count(*) AS hits FROM g GROUP BY key, grp""",
)
def merged_phrase_spans(spark, folder):
    return phrases.merged_spans(document_spans(spark, folder))


@register(
    "trigger_clauses",
    f"""WITH {LEXICON}, u AS (SELECT conv_id * 1000 + turn AS key, text FROM conversations), parts AS (
        SELECT key, generate_subscripts(ss, 1) - 1 AS position, unnest(ss) AS clause FROM (
            SELECT key, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \\t\\n')), lambda s: s <> '') AS ss FROM u)
    ), f AS (
        SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY key, lower(clause) ORDER BY position) = 1
    ), w AS (
        SELECT key, position, clause, ' ' || array_to_string(regexp_extract_all(lower(clause), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS flat FROM f
    ) SELECT key, CAST(position AS BIGINT) AS position, clause, EXISTS (SELECT 1 FROM lexicon l WHERE contains(flat, ' ' || phrase || ' ')) AS triggered FROM w""",
)
def trigger_clauses(spark, folder):
    said = src.table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return phrases.clauses(said, lexicon(spark, folder))


TOKENS_SQL = "list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda w: w <> '')"


def _edges_sql(lines: str) -> str:
    """Lifted edges of sentences s(key, tokens) whose mentions are the words of five letters and more that the benchmark has."""
    prep, aux, lead, light = quoted(morphology.PREPOSITIONS), quoted(morphology.AUXILIARY_WORDS), quoted(morphology.LEADING_WORDS), "('have', 'get', 'make', 'take', 'do', 'give')"
    return f"""WITH {lines}, names AS (
        SELECT DISTINCT name FROM (SELECT unnest({TOKENS_SQL.format(t='text')}) AS name FROM benchmark) WHERE len(name) >= 5
    ), m AS (
        SELECT key, name, min("at") AS "at" FROM (SELECT key, generate_subscripts(tokens, 1) AS "at", unnest(tokens) AS name FROM s) JOIN names USING (name) GROUP BY key, name
    ), p AS (
        SELECT key, name AS subject, "at", lead(name) OVER w AS object, lead("at") OVER w AS high FROM m WINDOW w AS (PARTITION BY key ORDER BY "at")
    ), b AS (
        SELECT p.*, tokens[p."at" + 1:high - 1] AS ts FROM p JOIN s USING (key) WHERE object IS NOT NULL
    ), c AS (
        SELECT *, ts[nullif(list_position(list_transform(ts, lambda t: NOT list_contains({lead}, t) AND NOT list_contains({quoted(lifts.ADVERBS)}, t)), true), 0):] AS us FROM b WHERE len(ts) > 0
    ), d AS (
        SELECT *, us[coalesce(nullif(list_position(list_transform(us, lambda t: NOT (list_contains({aux}, t) AND t NOT IN ('have', 'has', 'had', 'do', 'does', 'did'))), true), 0), len(us)):] AS vs FROM c WHERE len(us) > 0
    ), e AS (
        SELECT *, vs[1] AS head, coalesce(vs[2], '') AS second, {lemma_sql('vs[1]')} AS base, list_position(list_transform(vs[2:], lambda t: NOT (list_contains({aux}, t) OR list_contains({prep}, t) OR list_contains({lead}, t))), true) AS noun FROM d
    ), f AS (
        SELECT *, CASE WHEN base IN {light} THEN array_to_string(CASE WHEN noun > 0 THEN vs[:noun + 1] ELSE vs END, ' ') WHEN list_contains({prep}, second) THEN head || ' ' || second ELSE head END AS phrase FROM e
        WHERE NOT (list_contains({quoted(lifts.NUMBERS)}, head) OR regexp_matches(head, '^[0-9]') OR head IN ('name', 'names', 'named', 'naming', 'call', 'calls', 'called', 'calling') AND NOT list_contains({prep}, second)
            OR list_contains({quoted(lifts.CATENATIVE)}, base) AND second = 'to' OR list_contains({quoted(lifts.MENTAL)}, base) AND second IN ('to', 'of', 'about', 'for') OR list_contains({quoted(lifts.CONNECTORS)}, head) AND base NOT IN {light})
    ), {normal_sql('f', 'g')}, h AS (
        SELECT f.key, f."at", subject, normal AS rel_type, object FROM f JOIN g USING (phrase) WHERE normal <> '' AND NOT list_contains({quoted(lifts.CONNECTORS)}, normal)
    ), o AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at") AS position FROM h
    )"""


def lifted(said):
    """Lifted edges of texts (key, text), by their sentences."""

    def run(spark, folder):
        from factloom.operators.texts import sentences

        rows = said(spark, folder).select("key", F.posexplode(sentences(F.col("text"))).alias("line", "sentence"))
        parts = rows.select(F.struct("key", "line").alias("key"), phrases.tokens(F.col("sentence")).alias("tokens"), F.col("sentence").alias("text"))
        names = src.table(spark, folder, "benchmark").select(F.explode(phrases.tokens(F.col("text"))).alias("phrase")).where("length(phrase) >= 5")
        mentions = phrases.phrase_spans(parts.select("key", "text"), names, phrases.tokens).select("key", F.col("phrase").alias("name"), F.lit("NAME").alias("kind"), "at", "n")
        edges = lifts.lifted_edges(parts.select("key", "tokens"), mentions)
        return edges.select("key.key", F.col("key.line").cast("long").alias("line"), "position", "subject", "rel_type", "object")

    return run


def _lines(table: str, key: str) -> str:
    return f"""s AS (
        SELECT (key, line) AS key, {TOKENS_SQL.format(t='sentence')} AS tokens FROM (SELECT {key} AS key, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS sentence FROM (
            SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM {table}))
    )"""


EDGES_OUT = "SELECT key[1] AS key, CAST(key[2] AS BIGINT) AS line, position, subject, rel_type, object FROM o WHERE position <= 12"
register("lifted_edges_documents", f"{_edges_sql(_lines('documents', 'doc_id'))} {EDGES_OUT}")(lifted(lambda spark, folder: src.table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")))
register("lifted_edges_conversations", f"{_edges_sql(_lines('conversations', 'conv_id * 1000 + turn'))} {EDGES_OUT}")(lifted(lambda spark, folder: src.table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")))


@register(
    "possessive_object_heads",
    """SELECT p_partkey AS key, 'has_issue' AS rel_type, CASE WHEN p_partkey % 3 = 0 THEN replace(lower(p_brand), '#', '') WHEN p_partkey % 3 = 1 THEN 'cover' ELSE string_split(lower(p_name), ' ')[1] END AS object,
        CASE WHEN p_partkey % 3 = 0 THEN 'Object' END AS object_type, p_partkey % 3 <> 0 AS moved FROM part""",
)
def possessive_object_heads(spark, folder):
    """A third of the parts is named without a possessive, a third with a chain of two, a third with one."""
    part = src.table(spark, folder, "part").select("p_partkey", F.regexp_replace(F.lower("p_brand"), "#", "").alias("brand"), F.get(F.split(F.lower("p_name"), " "), F.lit(0)).alias("word"))
    case = lambda *said: F.element_at(F.array(*said), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = case(F.concat(F.lit("I had an issue with the "), "brand", F.lit(" unit's")), F.concat(F.lit("The "), "brand", F.lit("'s "), "word", F.lit("'s cover failed.")), F.concat(F.lit("My "), "brand", F.lit("'s the "), "word", F.lit(" in the hall")))
    texts = part.select(F.col("p_partkey").alias("key"), text.alias("text"))
    edges = part.select(F.col("p_partkey").alias("key"), F.lit("user").alias("subject"), F.lit("has_issue").alias("rel_type"), F.col("brand").alias("object"), F.lit("Object").alias("object_type"))
    return lifts.object_heads(edges, texts).select("key", "rel_type", "object", "object_type", "moved")


@register(
    "pronoun_names",
    """WITH RECURSIVE n AS (
        SELECT conv_id, turn, text, names, list_transform(names, lambda w: CASE w[-1] WHEN 'n' THEN 'spouse' WHEN 's' THEN 'child_of' WHEN 'e' THEN 'parent_of' ELSE 'likes' END) AS rels,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS names FROM conversations)
    ), r AS (
        SELECT conv_id, CAST(1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ring, CAST(NULL AS VARCHAR) AS she, CAST(NULL AS VARCHAR) AS they, CAST(NULL AS VARCHAR) AS it FROM n WHERE i = 1
        UNION ALL SELECT conv_id, i, ring, CASE WHEN list_contains(ring, she) THEN she END, CASE WHEN list_contains(ring, they) THEN they END, CASE WHEN list_contains(ring, it) THEN it END FROM (
            SELECT r.conv_id, r.i + 1 AS i, list_concat(ring, list_filter(names, lambda x, k: NOT list_contains(ring, x) AND list_position(names, x) = k))[-10:] AS ring,
                coalesce(list_filter(names, lambda x, k: rels[k] = 'spouse')[-1], she) AS she, coalesce(list_filter(names, lambda x, k: rels[k] IN ('child_of', 'parent_of'))[-1], they) AS they, coalesce(names[-1], it) AS it
            FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i)
    ), f AS (
        SELECT n.conv_id, turn, list_sort(list_distinct(list_filter([CASE WHEN contains(lower(text), 'she') OR contains(lower(text), 'he') THEN she END, CASE WHEN contains(lower(text), 'it') THEN it END,
            CASE WHEN contains(lower(text), 'they') THEN coalesce(they, ring[-1]) END], lambda x: x IS NOT NULL))) AS names FROM n JOIN r ON n.conv_id = r.conv_id AND n.i = r.i
    ) SELECT conv_id, turn, array_to_string(names, ',') AS names FROM f WHERE len(names) > 0""",
)
def pronoun_names(spark, folder):
    """Names are the capitalised words of six letters and more; their last letter tells the relation."""
    said = src.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    last = F.right("name", F.lit(1))
    named = said.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"))).alias("place", "name"))
    named = named.withColumn("relation", F.when(last == "n", "spouse").when(last == "s", "child_of").when(last == "e", "parent_of").otherwise("likes"))
    return mentions.pronoun_names(said, named, part=8).select("conv_id", "turn", F.array_join("names", ",").alias("names"))
