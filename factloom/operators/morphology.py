"""Relation phrases in normal form: lemmas, light verbs, and the fold onto seeded relations.

Everything is an ordered set of rewrites in native expressions.  The word classes
are closed: a word that no rule knows stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed word classes of relation phrases.
#: Words that never carry a relation when they lead.
LEADING_WORDS = "the a an i you he she it we they me him her us them my your his its our their this that these those".split()
#: Auxiliaries and the mark of the infinitive.
AUXILIARY_WORDS = "is are was were be been being am do does did have has had will would shall should can could may might must to".split()
#: Prepositions that tell relations apart.
PREPOSITIONS = "in at on of for from by as into to with about".split()
DETERMINERS = ["the", "a", "an"]
#: Verbs whose object carries the meaning, and the form in which they stand before it.
LIGHT_VERBS = {"have": "has", "get": "gets", "make": "makes", "take": "takes", "do": "does", "give": "gives"}
#: What is left of contractions: those that stand for a verb, and those that stand for nothing.
CLITICS = {"ve": "have", "ll": "will", "d": "had"}
RESIDUES = ["s", "t", "re", "m"]
#: Irregular forms.
IRREGULAR = {
    "had": "have", "has": "have", "having": "have", "was": "be", "were": "be", "been": "be", "being": "be", "am": "be", "is": "be", "are": "be",
    "did": "do", "does": "do", "doing": "do", "made": "make", "making": "make", "went": "go", "gone": "go", "going": "go", "got": "get", "gotten": "get", "getting": "get",
    "knew": "know", "known": "know", "knowing": "know", "met": "meet", "meeting": "meet", "owned": "own", "owning": "own", "lived": "live", "living": "live", "born": "bear",
    "ran": "run", "running": "run", "bought": "buy", "buying": "buy", "built": "build", "building": "build", "kept": "keep", "keeping": "keep", "left": "leave", "leaving": "leave",
    "told": "tell", "telling": "tell", "worked": "work", "working": "work", "studied": "study", "studying": "study", "preferred": "prefer", "preferring": "prefer",
    "liked": "like", "liking": "like", "disliked": "dislike", "disliking": "dislike", "named": "name", "naming": "name",
}

#: Suffix rules, first match first: what the word looks like, and what stands for its ending; an ``e`` may come back to a bare stem.
SUFFIXES = [
    (r"^.{2,}ing$", "ing$", "", True),
    (r"^.{2,}ied$", "ied$", "y", False),
    (r"^.{2,}ed$", "ed$", "", True),
    (r"^.+ies$", "ies$", "y", False),
    (r"^(?:.+(?:ch|sh)|.{2,}[xzo])es$", "es$", "", False),
    (r"^.{2,}[^s]s$", "s$", "", False),
]
SILENT_E = r"^(?:.+[^l]l|.{2,}[vzu]|.+[aeiou][cgs]|(?:.*[^e])at)$"


def _among(word: Column, words) -> Column:
    return word.isin(list(words))


def restored(stem: Column) -> Column:
    """A stem of three letters or more with the silent e that its ending lost."""
    return F.when((F.length(stem) >= 3) & stem.rlike(SILENT_E), F.concat(stem, F.lit("e"))).otherwise(stem)


def regular_lemma(word: Column) -> Column:
    """The base form by the suffix rules alone."""
    out = None
    for form, ending, put, silent in SUFFIXES:
        stem = F.regexp_replace(word, ending, put)
        hit = word.rlike(form)
        out = F.when(hit, restored(stem) if silent else stem) if out is None else out.when(hit, restored(stem) if silent else stem)
    return out.otherwise(word)


def lemma(word: Column) -> Column:
    """The base form of a lowered word: irregular forms first, then the suffix rules."""
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), regular_lemma(word))


def _from_first(tokens: Column, skipped) -> Column:
    """The tokens from the first that is not skipped; none if all are."""
    first = F.array_position(F.transform(tokens, lambda t: ~skipped(t)), True).cast("int")
    return _bound(first, lambda at: F.when(at > 0, F.slice(tokens, at, F.size(tokens))).otherwise(F.slice(tokens, 1, 0)))


def _keeping_last(tokens: Column, skipped) -> Column:
    return _bound(_from_first(tokens, skipped), lambda rest: F.when(F.size(rest) > 0, rest).otherwise(F.slice(tokens, -1, 1)))


def bare_words(text: Column) -> Column:
    """Words of ASCII letters and digits, lowered."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


#: Auxiliaries that only tell the tense: those that are no light verbs.
TENSE_WORDS = [w for w in AUXILIARY_WORDS if IRREGULAR.get(w, w) not in LIGHT_VERBS]


def normal_form(phrase: Column) -> Column:
    """A relation phrase as a name: ``had an issue with`` is has_issue, ``is living in`` is live_in; empty if nothing is left."""
    return F.coalesce(_named(bare_words(phrase)), F.lit(""))


def _named(words: Column) -> Column:
    clitics = F.create_map(*[F.lit(x) for pair in CLITICS.items() for x in pair])
    words = F.transform(F.filter(words, lambda t: ~_among(t, RESIDUES)), lambda t: F.coalesce(F.try_element_at(clitics, t), t))
    # Each step is bound by a one-element transform, so that none is computed anew wherever it is used.
    return _bound(words, lambda ws: F.when(F.size(ws) == 0, F.lit("")).when(F.forall(ws, lambda t: _among(t, LEADING_WORDS)), regular_lemma(F.try_element_at(ws, F.lit(-1)))).otherwise(
        _bound(_keeping_last(_from_first(ws, lambda t: _among(t, LEADING_WORDS)), lambda t: _among(t, TENSE_WORDS)), lambda rest: _bound(lemma(F.get(rest, F.lit(0))), lambda head: _built(head, F.slice(rest, 2, F.size(rest)))))
    ))


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _built(head: Column, rest: Column) -> Column:
    light = F.try_element_at(F.create_map(*[F.lit(x) for pair in LIGHT_VERBS.items() for x in pair]), head)
    noun = F.get(F.filter(rest, lambda t: ~_among(t, {*DETERMINERS, *AUXILIARY_WORDS, *PREPOSITIONS})), F.lit(0))
    kept = F.filter(rest, lambda t: _among(t, PREPOSITIONS) | ~_among(t, {*DETERMINERS, *AUXILIARY_WORDS}))
    tail = F.transform(kept, lambda t: F.when(_among(t, PREPOSITIONS), t).otherwise(lemma(t)))
    plain = F.array_join(F.concat(F.array(head), tail), "_")
    return F.when(light.isNotNull() & noun.isNotNull(), F.concat(light, F.lit("_"), lemma(noun))).when(light.isNotNull(), light).when(_among(plain, [*CLITICS, *RESIDUES]), F.lit("")).otherwise(plain)


def fold_onto_seeded(surfaces: DataFrame, seeded: DataFrame) -> DataFrame:
    """(surface, normal, rel_type): the seeded relation (rel_type) whose normal form a surface has; null for none.

    A surface that already is that relation is not folded.  Of seeded relations
    with one normal form the least is taken; relations that grew are not targets.
    """
    targets = seeded.select(F.lower("rel_type").alias("rel_type")).withColumn("normal", normal_form(F.col("rel_type"))).where("normal <> ''").groupBy("normal").agg(F.min("rel_type").alias("rel_type"))
    met = surfaces.select("surface", normal_form(F.col("surface")).alias("normal")).join(targets, "normal", "left")
    return met.select("surface", "normal", F.when(F.col("rel_type") != F.lower(F.trim("surface")), F.col("rel_type")).alias("rel_type"))
