"""Phrases of a lexicon in texts, by a token trie laid out as joins.

Texts become rows of a token each, with the few tokens that follow it.  A token
meets the lexicon's first words, which tell what lengths to try there; the runs
of those lengths meet the phrases by equality.  The work grows with the text and
with the matches, not with the lexicon, and no join is a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.texts import sentences
from factloom.scratch import staged


def tokens(text: Column) -> Column:
    """Lowered words of ASCII letters, digits and apostrophes; all else parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9']+", " "), " "), lambda t: t != "")


def words(text: Column) -> Column:
    """Lowered words of letters and digits of any script; all else parts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase_spans(texts: DataFrame, lexicon: DataFrame, split=words) -> DataFrame:
    """(key, phrase, at, n): every occurrence of a phrase (phrase) in a text (key, text), as a run of n tokens from token at.

    Phrases match whole tokens, whatever parts these.  Phrases with equal tokens
    are one phrase each; a phrase without tokens matches nothing.
    """
    listed = lexicon.select("phrase").where("phrase is not null").distinct().withColumn("ts", split(F.col("phrase"))).where("size(ts) > 0")
    # The lexicon and its first words are tables of a known size: where they are small, no token is dealt out by its word.
    listed = staged(listed.select("phrase", F.array_join("ts", " ").alias("run"), F.get("ts", F.lit(0)).alias("head"), F.size("ts").alias("n")), "phrases-listed")
    longest = listed.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    heads = staged(listed.groupBy("head").agg(F.collect_set("n").alias("lengths")), "phrases-heads")  # as many as there are lengths of phrases
    ts = F.col("ts")
    places = F.transform(ts, lambda t, i: F.struct(t.alias("head"), i.alias("at"), F.slice(ts, i + 1, longest).alias("ahead")))
    rows = texts.select("key", split(F.col("text")).alias("ts")).select("key", F.inline(places))
    tried = rows.join(heads, "head").select("key", "at", "ahead", F.explode("lengths").alias("n")).where("n <= size(ahead)")
    runs = tried.select("key", "at", "n", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("run"))
    return runs.join(listed.select("run", "phrase"), "run").select("key", "phrase", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(key, at, n, hits): overlapping or touching spans of a key joined to one."""
    order = Window.partitionBy("key").orderBy("at", "n")
    ends = spans.withColumn("reach", F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("reach") >= F.col("at"), 0).otherwise(1)
    numbered = ends.withColumn("group", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "group").agg(F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).alias("n"), F.count("*").alias("hits")).drop("group")


def longest_phrase(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase, target): of the phrases (phrase, priority, target) in a text the one of highest priority, then the longest."""
    order = phrases.orderBy("priority", F.length("phrase"), "phrase", "target")
    ranked = staged(order.select("phrase", "target", F.monotonically_increasing_id().alias("rank")), "phrases-ranked")  # the greatest number needs no sort
    met = phrase_spans(texts, ranked).join(ranked.select("phrase", "rank"), "phrase")
    return met.groupBy("key").agg(F.max("rank").alias("rank")).join(ranked, "rank").select("key", "phrase", "target")


def clauses(texts: DataFrame, triggers: DataFrame, pattern: str | None = None) -> DataFrame:
    """(key, position, clause, triggered): a text's sentences, no sentence twice in whatever case, and whether a trigger phrase (phrase) or the pattern of all triggers is in it.

    A text without a sentence end is its own clause; blank texts have none.
    """
    parts = texts.select("key", F.posexplode(sentences(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("position", "clause"))
    first = parts.groupBy("key", F.lower("clause").alias("low")).agg(F.min(F.struct("position", "clause")).alias("x")).select("key", "x.position", "x.clause")
    said = first.select(F.struct("key", "position").alias("key"), F.col("clause").alias("text"))
    hit = phrase_spans(said, triggers).select("key.key", "key.position").distinct().withColumn("triggered", F.lit(True))
    return first.join(hit, ["key", "position"], "left").select("key", F.col("position").cast("long").alias("position"), "clause", (F.coalesce("triggered", F.lit(False)) | (F.col("clause").rlike(f"(?i){pattern}") if pattern else F.lit(False))).alias("triggered"))
