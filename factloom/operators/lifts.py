"""Edges read from the words between mentions, and objects moved from a possessor to what it has.

A sentence is its tokens (``phrases.tokens``); a mention is a run of them.  Verbs
bind only neighbouring mentions, so none reaches over the one between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.morphology import AUXILIARY_WORDS, LEADING_WORDS, LIGHT_VERBS, PREPOSITIONS, TENSE_WORDS, _bound, _from_first, _keeping_last, lemma, normal_form
from factloom.shipping import ship

MOST_EDGES, MOST_HEAD_WORDS = 12, 4

# Closed classes of words between two mentions.
ADVERBS = "just finally already recently also then once even really actually still now today yesterday".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve dozen hundred thousand million first second third couple few several many some".split()
CONNECTORS = "the a an of and or to with for in on at is are was were be been being am 's s".split()
NAMING = "name names named naming call calls called calling".split()
CATENATIVE = "like love hate want wish hope plan try need intend prefer enjoy expect decide choose mean aim agree offer promise refuse tend happen manage fail seem appear".split()
MENTAL = "think consider dream hope wish plan imagine contemplate ponder fancy intend want wonder".split()
OPENERS = ["to", "of", "about", "for"]
#: What ends the words of a possessed thing.
CLAUSE_WORDS = "and or but nor yet so when while because although though if unless since whereas where after before until than that which who then however therefore thus".split()
ENDS = [*PREPOSITIONS, *AUXILIARY_WORDS, *CLAUSE_WORDS]


def predicate(between: Column, content_verbs_only: bool = False) -> Column:
    """The relation that the words between two mentions state; null if none.

    Leading pronouns, determiners, adverbs and tense words go.  Numbers, naming
    verbs, wishes (``want to``), opinions (``think of``) and bare connectors state
    nothing.  A light verb takes its object in, another verb the preposition
    that follows it at once.  With ``content_verbs_only`` neither light verbs nor
    auxiliaries count.
    """
    led = lambda ws: _from_first(ws, lambda t: t.isin([*LEADING_WORDS, *ADVERBS]))
    rest = lambda ws: _keeping_last(ws, lambda t: t.isin(TENSE_WORDS))
    return _bound(_bound(_bound(between, led), rest), lambda r: _bound(lemma(F.get(r, F.lit(0))), lambda base: _stated(r, F.get(r, F.lit(0)), F.coalesce(F.get(r, F.lit(1)), F.lit("")), base, content_verbs_only)))


def _stated(rest: Column, head: Column, second: Column, base: Column, content_verbs_only: bool) -> Column:
    light = base.isin(list(LIGHT_VERBS))
    nothing = (
        head.isin(NUMBERS)
        | head.rlike("^[0-9]")
        | (head.isin(NAMING) & ~second.isin(PREPOSITIONS))
        | (base.isin(CATENATIVE) & (second == "to"))
        | (base.isin(MENTAL) & second.isin(OPENERS))
        | (head.isin(CONNECTORS) & ~light)
    )
    if content_verbs_only:
        nothing = nothing | head.isin(AUXILIARY_WORDS) | (base == "be") | light
    tail = F.slice(rest, 2, F.size(rest))
    noun = F.array_position(F.transform(tail, lambda t: ~t.isin([*AUXILIARY_WORDS, *PREPOSITIONS, *LEADING_WORDS])), True).cast("int")
    phrase = F.when(light, F.array_join(F.slice(rest, F.lit(1), F.when(noun > 0, noun + 1).otherwise(F.size(rest))), " ")).when(second.isin(PREPOSITIONS), F.concat(head, F.lit(" "), second)).otherwise(head)
    return F.when((F.size(rest) > 0) & ~nothing, _bound(normal_form(phrase), lambda name: F.when((name != "") & ~name.isin(CONNECTORS), name)))


def lifted_edges(sentences: DataFrame, mentions: DataFrame, most: int | None = MOST_EDGES) -> DataFrame:
    """(key, position, subject, rel_type, object, subject_type, object_type): what the words between neighbouring mentions state.

    ``sentences`` has key and tokens, ``mentions`` key, name, kind, at and n.  A
    name counts where it first stands; mentions that overlap state nothing.  Of
    a sentence the first ``most`` edges count, which is what the surveyed system
    reads (None: all); position numbers them.
    """
    first = mentions.groupBy("key", F.lower("name").alias("name")).agg(F.min(F.struct("at", "n", "kind")).alias("x")).select("key", "name", "x.*")
    along = Window.partitionBy("key").orderBy("at", "n", "name")
    ahead = lambda c: F.lead(c).over(along)
    pairs = first.select("key", F.col("name").alias("subject"), F.col("kind").alias("subject_type"), (F.col("at") + F.col("n")).alias("low"), ahead("name").alias("object"), ahead("kind").alias("object_type"), ahead("at").alias("high"), "at")
    pairs = pairs.where("object is not null and high > low")
    between = F.slice("tokens", F.col("low").cast("int") + 1, (F.col("high") - F.col("low")).cast("int"))
    found = pairs.join(sentences, "key").select("key", "at", "subject", predicate(between).alias("rel_type"), "object", "subject_type", "object_type")
    order = Window.partitionBy("key").orderBy("at", "subject").rowsBetween(Window.unboundedPreceding, 0)
    numbered = found.withColumn("position", F.count("rel_type").over(order)).where("rel_type is not null")
    return (numbered if most is None else numbered.where(F.col("position") <= most)).drop("at")


def possessives(text: str) -> list[tuple[int, str, str]]:
    """(place, owner, head) of every possessive of a lowered text; the owner as one, two and three words.

    The walk goes from the right, so a possessive meets the head of the one that
    follows it.  A head has up to four words and ends at prepositions,
    auxiliaries, words that begin a clause, verbs in -ed or -ing after its first
    word, and punctuation.
    """
    words = _PARTS.findall(text.replace("’", "'"))
    heads: dict[int, str] = {}
    for i in range(len(words) - 1, -1, -1):
        if not _CLITIC.search(words[i]):
            continue
        run: list[str] = []
        for j in range(i + 1, len(words)):
            bare = _CLITIC.sub("", words[j])
            owns = bare != words[j]
            if not _WORDLIKE.match(bare) or bare in _ENDS or (owns and bare in LEADING_WORDS):
                break
            if bare in LEADING_WORDS:
                continue
            if len(run) >= MOST_HEAD_WORDS or (run and bare.endswith(("ed", "ing"))):
                break
            if owns:
                run = [heads[j]] if j in heads else run
                break
            run.append(bare)
        if run:
            heads[i] = " ".join(run)
    return [(i, " ".join([*words[i - k : i], _CLITIC.sub("", words[i])]), head) for i, head in sorted(heads.items()) for k in range(min(3, i + 1))]


_PARTS = re.compile(r"[a-z0-9'\-]+|[^a-z0-9'\- ]+")
_CLITIC = re.compile(r"(?<=[a-z0-9])'s?$")
_WORDLIKE = re.compile(r"[a-z0-9'\-]")
_ENDS = frozenset(ENDS)


def object_heads(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (key, subject, rel_type, object, object_type) whose object is a possessor in its text (key, text) get what it has.

    The object's type goes with the possessor: a rewritten object has none.  Of
    several possessives of one owner the first counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, *one) for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()) for one in possessives(text.lower())]
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "i", "name", "head"), row)) for row in found], pa.schema([batch.schema.field("key"), ("i", pa.int32()), ("name", pa.string()), ("head", pa.string())]))

    ship(texts.sparkSession)
    kind = texts.schema["key"].dataType.simpleString()
    owning = texts.where(F.contains("text", F.lit("'")) | F.contains("text", F.lit("’"))).select("key", "text")
    found = owning.mapInArrow(run, f"key {kind}, i int, name string, head string")
    owners = found.groupBy("key", "name").agg(F.min_by("head", "i").alias("head"))
    met = edges.withColumn("name", F.lower(F.trim("object"))).join(owners, ["key", "name"], "left")
    moved = F.col("head").isNotNull() & (F.col("head") != F.col("name"))
    return met.select("key", "subject", "rel_type", F.when(moved, F.col("head")).otherwise(F.col("object")).alias("object"), F.when(~moved, F.col("object_type")).alias("object_type"), moved.alias("moved"))
