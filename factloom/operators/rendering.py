"""Plain-language rendering of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.morphology import lemma

EMPTY = "Nothing known."


def display_name(ident: Column, alias: Column, user: Column) -> Column:
    """Alias, else id; the user is "you", an empty id unknown."""
    return F.when(ident == user, F.lit("you")).when(F.coalesce(ident, F.lit("")) == "", F.lit("unknown")).otherwise(F.coalesce(alias, ident))


def sentence(template: Column, rel: Column, x: Column, y: Column, second: Column | None = None, you: Column | None = None) -> Column:
    """The template with its hint stripped and its slots filled; without one, the relation in words.

    Where the subject is the user (``you``), the template of the second person
    (``second``) takes its place, if there is one.
    """
    if second is not None and you is not None:
        template = F.when(F.coalesce(you, F.lit(False)) & second.isNotNull(), second).otherwise(template)
    bare = F.trim(F.regexp_replace(template, r"\s*\([^()]*\)\s*$", ""))
    used = F.when(bare == "", template).otherwise(bare)
    filled = F.replace(F.replace(used, F.lit("{x}"), x), F.lit("{y}"), y)
    return F.coalesce(filled, F.concat_ws(" ", x, F.replace(rel, F.lit("_"), F.lit(" ")), y))


def article(word: Column) -> Column:
    """a or an, initials by how their first letter is said."""
    initials = word.rlike("^[A-Z0-9]{2,}$")
    spoken = F.when(initials, word.rlike("^[AEFHILMNORSX8]")).otherwise(F.lower(word).rlike("^[aeiou]"))
    return F.when(spoken, F.lit("an")).otherwise(F.lit("a"))


#: Past forms without -ed, and what stands before a thing that is had.
PASTS = "made went got knew met ran bought built kept left told".split()
HELD = r"^(.+?) (have|has|had) ((?:a|an|the|my|your|his|her|its|our|their|some|any)\b.*)$"
LEXICAL = r"^(\S+) ([A-Za-z]+) ([^0-9\s].*)$"


def negated(text: Column) -> Column:
    """The sentence with not after its auxiliary; a full verb behind a one-word subject takes do-support; negative ones stay, others are wrapped.

    A thing that is had takes do-support too.  Without a parser a full verb is a
    word in -s or -ed, or an irregular past, that more words follow, a number
    aside; whatever else has no auxiliary is wrapped as a whole.
    """
    aux = r"\b(is|are|was|were|am|can|could|will|would|should|must|has|have|had|does|do|did)\b"
    operator = F.when(F.regexp_extract(text, HELD, 2) == "has", "does").when(F.regexp_extract(text, HELD, 2) == "had", "did").otherwise("do")
    held = F.concat_ws(" ", F.regexp_extract(text, HELD, 1), operator, F.lit("not have"), F.regexp_extract(text, HELD, 3))
    verb = F.regexp_extract(text, LEXICAL, 2)
    past = verb.isin(PASTS) | verb.rlike("[a-z]{2}ed$")
    present = verb.rlike("[a-z]{2}[^s]s$|[a-z]es$") & ~verb.rlike("ss$")
    full = F.concat_ws(" ", F.regexp_extract(text, LEXICAL, 1), F.when(past, "did").otherwise("does"), F.lit("not"), F.when(verb == "goes", "go").otherwise(lemma(verb)), F.regexp_extract(text, LEXICAL, 3))
    return (
        F.when(text == "", text)
        .when(F.lower(text).rlike(r"\b(not|never|no)\b|n't\b"), text)
        .when(text.rlike(HELD), held)
        .when(text.rlike(aux), F.regexp_replace(text, "^(.*?)" + aux, "$1$2 not"))
        .when(past | present, full)
        .otherwise(F.concat(F.lit("it is not the case that "), text))
    )


def dated(text: Column, date: Column) -> Column:
    return F.when(date.isNull(), text).otherwise(F.concat(text, F.lit(" (on "), F.date_format(date, "yyyy-MM-dd"), F.lit(")")))


def recall(facts: DataFrame, key: str, most: int | None = None, date: str | None = None) -> DataFrame:
    """A block of text per key: dated events in their order, then asserted sentences by confidence, then tentative ones, without repeats.

    Only class C is tentative.  ``date`` names the column of event dates, where the order of events is asked for; without
    it no sentence is an event.  Every sentence is in the block; ``most`` asks for the first ones of each key instead.
    """
    from pyspark.sql import Window

    tentative = F.coalesce(F.upper("fact_class") == "C", F.lit(False))
    day = F.min(date) if date else F.lit(None).cast("date")
    best = facts.groupBy(key, "text").agg(F.min(tentative).alias("tentative"), F.max("confidence").alias("confidence"), day.alias("day"))
    best = best.withColumn("section", F.when(F.col("day").isNotNull(), 0).when(~F.col("tentative"), 1).otherwise(2))
    if most is not None:
        place = Window.partitionBy(key).orderBy("section", "day", F.desc_nulls_last("confidence"), "text")
        best = best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    rank = F.when(F.col("section") > 0, -F.coalesce("confidence", F.lit(float("-inf"))))
    lines = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("section", "day", rank.alias("rank"), "text"))))
    of = lambda n: F.filter("lines", lambda x: x["section"] == n)
    dashed = lambda n: F.nullif(F.array_join(F.transform(of(n), lambda x: F.concat(F.lit("- "), x["text"])), "\n"), F.lit(""))
    event = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.date_format(x["day"], "yyyy-MM-dd"), F.lit("] "), x["text"])
    events = F.nullif(F.array_join(F.transform(of(0), event), "\n"), F.lit(""))
    titled = lambda title, text: F.concat(F.lit(title + "\n"), text)
    block = F.concat_ws("\n", titled("In order:", events), dashed(1), titled("Perhaps:", dashed(2)))
    return best.groupBy(key).agg(lines.alias("lines")).select(key, F.coalesce(F.nullif(block, F.lit("")), F.lit(EMPTY)).alias("block"))


#: What a third-person sentence says wrongly of "you".
AGREEMENT = [(r"\byou's\b", "your"), (r"\byou is\b", "you are"), (r"\byou has\b", "you have"), (r"\byou was\b", "you were"), (r"\byou does\b", "you do")]
HIERARCHY = ["instance_of", "subclass_of"]


def agreed(text: Column) -> Column:
    """The sentence with the few verbs set right that follow "you"; others are not touched."""
    for wrong, right in AGREEMENT:
        text = F.regexp_replace(text, wrong, right)
    return text


def template_verb(template: Column) -> Column:
    """The word after a template's subject (X, You or {x}); null without one."""
    return F.nullif(F.lower(F.regexp_extract(template, r"^(?:[Xx]|[Yy]ou|\{x\})\s+([A-Za-z]+)\b", 1)), F.lit(""))


def titled(text: Column, names: Column) -> Column:
    """The sentence with the names of its slots capitalised as whole words, the longest first; "you" stays."""
    longest = F.reverse(F.array_sort(F.transform(F.filter(names, lambda n: (n != "") & (F.lower(n) != "you")), lambda n: F.struct(F.length(n).alias("size"), n.alias("name")))))
    whole = lambda n: F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))
    one = lambda acc, n: F.call_function("regexp_replace", acc, whole(n["name"]), F.initcap(n["name"]))
    return F.aggregate(longest, text, one)


def object_clause(rel: Column, subject: Column, obj: Column, kind: Column, is_you: Column, verb: Column, is_id: Column, scalar: Column) -> Column:
    """A clause by the shape of its object: a named instance of a kind, a bare type, a value, else null for the template.

    A named instance needs an entity whose kind is known and is not its name
    (``has a dog named rex``); a type gets its article; a value follows the verb.
    """
    held = F.coalesce(verb, F.lit("has"))
    of_kind = F.when(is_id & kind.isNotNull() & (F.lower(kind) != F.lower(obj)), F.concat_ws(" ", subject, held, article(kind), kind, F.lit("named"), obj))
    bare = F.when(rel.isin(HIERARCHY), F.concat_ws(" ", subject, F.when(is_you, F.lit("are")).otherwise(F.lit("is")), article(obj), obj))
    value = F.when(scalar, F.concat_ws(" ", F.when(is_you, F.lit("your")).otherwise(F.concat(subject, F.lit("'s"))), F.replace(rel, F.lit("_"), F.lit(" ")), F.lit("is"), obj))
    return F.coalesce(bare, value, of_kind)


def inverse_pairs(rendered: DataFrame, inverses: DataFrame) -> DataFrame:
    """One of two sentences (id, subject, rel_type, object, is_you) that say the same from both sides: the one about the user, else the first.

    ``inverses`` (rel_type, inverse) names relations that are each other's inverse.
    """
    rows = rendered.join(inverses, "rel_type", "left")
    turned = F.col("inverse").isNotNull() & (F.col("inverse") < F.col("rel_type"))
    pair = F.when(turned, F.struct(F.col("inverse").alias("r"), F.col("object").alias("s"), F.col("subject").alias("o"))).otherwise(F.struct(F.col("rel_type").alias("r"), F.col("subject").alias("s"), F.col("object").alias("o")))
    best = F.min_by(F.struct(*rendered.columns), F.struct(~F.col("is_you"), "id"))
    return rows.withColumn("pair", pair).groupBy("pair").agg(best.alias("x")).select("x.*")
