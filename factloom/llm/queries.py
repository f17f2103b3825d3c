"""The corpus operators as queries with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import dac, exact_dedup, html_text, language, line_dedup, mixing, near_dedup, packing, quality, resampling, separators, suffix_dedup, whitening

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_register(
    "op1_minhash_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), g AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS shingle FROM w
    ), n AS (
        SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
    ), p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (
        SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 85 * (u.n + v.n - c)
    ), e AS (
        SELECT x, y FROM l UNION ALL SELECT y, x FROM l
    ), r(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other
    ), m AS (
        SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
    )
    SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), k=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


@_register("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, log-likelihood score and verdict of every document."""
    labels = _table(spark, folder, "labels").where("quality = 1")
    return quality.judged(_table(spark, folder, "documents"), labels).drop("key")


@_register("op3_html_extraction")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, folder, "pages"))


@_register("op4_line_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every document that repeat or nearly repeat an earlier line of the corpus."""
    return line_dedup.similar_lines(_table(spark, folder, "documents"))


@_register("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return language.identify(_table(spark, folder, "documents"))


@_register("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return separators.token_counts(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@_register(
    "op7_source_mix",
    r"""
    WITH d AS (
        SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
    ), o AS (
        SELECT *, (rank - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
    ), f AS (
        SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_words,
            CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_weight FROM o
    ), b AS (
        SELECT left_words AS words, left_weight AS weights FROM f WHERE 3 * source_size * left_weight > left_words * weight ORDER BY left_weight DESC LIMIT 1
    ), t AS (
        SELECT f.source, source_size, CASE WHEN 3 * source_size * left_weight > left_words * weight THEN CAST(words AS DOUBLE) * weight / weights ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM f LEFT JOIN b ON true
    ), q AS (
        SELECT f.*, target, CAST(round(target) AS BIGINT) AS quota, target = 3 * f.source_size AND NOT 3 * f.source_size * left_weight > left_words * weight AS capped FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
    ), c AS (
        SELECT *, CAST(sum(quota) OVER (ORDER BY rank) AS BIGINT) AS upto, CAST(sum(quota) OVER () AS BIGINT) AS quotas, CAST(ceil(total / least(total, 262144)) AS BIGINT) AS block FROM q WHERE total > 0
    ), r AS (
        SELECT *, CAST(floor(CAST(upto - quota AS DOUBLE) / CAST(quotas AS DOUBLE) * 4294967296) AS BIGINT) AS low, CAST(floor(CAST(upto AS DOUBLE) / CAST(quotas AS DOUBLE) * 4294967296) AS BIGINT) AS high,
            CAST(ceil(total / block) AS BIGINT) AS n FROM c
    ), i AS (
        SELECT unnest(generate_series(0, (SELECT max(n) FROM r) - 1)) AS slot
    ), h AS (
        SELECT rank, slot, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS k FROM i JOIN r ON slot * 2654435769 % 4294967296 >= low AND slot * 2654435769 % 4294967296 < high
    ), e AS (
        SELECT r.*, CASE WHEN capped THEN quota ELSE least(coalesce(got, 0) * block, 3 * source_size) END AS share, coalesce(got, 0) AS got FROM r LEFT JOIN (SELECT rank, count(*) AS got FROM h GROUP BY rank) g ON r.rank = g.rank
    ), k AS (
        SELECT rank, k, slot FROM h UNION ALL SELECT rank, k, n + k FROM (SELECT rank, n, unnest(generate_series(got, CAST(ceil(share / block) AS BIGINT) - 1)) AS k FROM e)
    ), a AS (
        SELECT d.doc_id, d.size, t.source_size, t.target, rank, coalesce(share, 0) AS share, block,
            CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS at_word
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
    ), m AS (
        SELECT *, greatest(0, least(at_word + size, share) - at_word) + greatest(0, least(source_size + at_word + size, share) - source_size - at_word)
            + greatest(0, least(2 * source_size + at_word + size, share) - 2 * source_size - at_word) AS taken FROM a
    )
    SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot FROM m LEFT JOIN k ON k.rank = m.rank AND k.k = at_word // block
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document, and the slot of the schedule where it first does."""
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


@_register(
    "op8_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
    ), g AS (
        SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The document that stays of every group of equal texts."""
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


@_register("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every piece of every document in windows of 2048 tokens."""
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@_register("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """What the directly addressable token files say of every document."""
    return dac.token_files(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@_register("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The first 32 whitened components of every embedding."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


@_register(
    "op12_importance_resampling",
    r"""
    WITH t AS (
        SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM (SELECT unnest(generate_series(0, 255)) AS i)
    ), a AS (
        SELECT doc_id, false AS wanted, text FROM documents UNION ALL SELECT NULL, true, text FROM benchmark
    ), w AS (
        SELECT doc_id, wanted, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM a
    ), v AS (
        SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)
    ), y AS (
        SELECT word, list_concat([4294967295], list_transform(generate_series(1, CAST(len(h) AS BIGINT), 2), lambda i: 16 * (instr('123456789ABCDEF', h[i])) + instr('123456789ABCDEF', h[i + 1]))) AS bytes FROM v
    ), b AS (
        SELECT word, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, t
    ), c AS (
        SELECT bucket, count(*) FILTER (wanted) AS t, count(*) FILTER (NOT wanted) AS s FROM w JOIN b USING (word) GROUP BY bucket
    ), g AS (
        SELECT bucket, CAST(floor(1000 * ln((t + 1) * CAST((SELECT sum(s) FROM c) + 10000 AS DOUBLE) / ((s + 1) * CAST((SELECT sum(t) FROM c) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c
    ), f AS (
        SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE NOT wanted GROUP BY doc_id
    ), o AS (
        SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id
    ), r AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20
    )
    SELECT o.doc_id, n_features, weight, score, rank FROM o LEFT JOIN r ON r.doc_id = o.doc_id AND rank <= n * 10 // 100
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark's distribution of words."""
    found = resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@_register(
    "op13_suffix_array_dedup",
    """
    WITH d AS (
        SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
    ), w AS (
        SELECT doc_id, i, array_slice(x, i + 1, i + 50) AS s FROM (SELECT doc_id, x, unnest(generate_series(0, n_bytes - 50)) AS i FROM d WHERE n_bytes >= 50)
    ), m AS (
        SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
    ), r AS (
        SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN m USING (s) WHERE doc_id > least
    ), g AS (
        SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r
    ), p AS (
        SELECT doc_id, span, min(i) AS low, max(i) + 50 AS high FROM g GROUP BY doc_id, span
    ), k AS (
        SELECT p.doc_id, high - low AS gone, low, hex(array_slice(x, coalesce(lag(high) OVER o, 0) + 1, low)) AS kept,
            CASE WHEN lead(low) OVER o IS NULL THEN hex(array_slice(x, high + 1, n_bytes)) ELSE '' END AS rest
        FROM p JOIN d ON d.doc_id = p.doc_id WINDOW o AS (PARTITION BY p.doc_id ORDER BY low)
    ), e AS (
        SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(kept || rest, '' ORDER BY low) AS kept FROM k GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(e.kept), x)) AS kept_sha256
    FROM d LEFT JOIN e ON e.doc_id = d.doc_id
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document when strings of 50 bytes that earlier documents hold are removed."""
    return suffix_dedup.repeated_passages(_table(spark, folder, "documents"))
