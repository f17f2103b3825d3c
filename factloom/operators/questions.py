"""Questions as plans: what order, bounds, status and calculation a question asks for, and the dated facts that answer it.

The grammar is a few closed sets of cue words in native expressions, so that a
column of questions is planned at once; what no cue tells stays null.  Answers
cite the dates that they come from, and a question whose events have no date is
a miss, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.dates import clock
from factloom.operators.morphology import _bound, lemma
from factloom.scratch import staged

# Cue words of questions.
FIRST = r"\b(?:first|earliest|oldest|initially)\b"
LATEST = r"\b(?:latest|newest|most recent|most recently|last)\b(?! (?:week|month|year|night|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b)"
FUTURE = r"\b(?:coming up|upcoming|scheduled|planned for|in the future)\b"
HISTORY = r"\b(?:used to|previously|previous|formerly|no longer|anymore|did (?:i|we) ever|have (?:i|we) ever)\b"
AFTER, BEFORE = r"\b(?:after|since)\b", r"\b(?:before|prior to|until)\b"
MONTHS = "january february march april may june july august september october november december".split()
IN_MONTH = rf"\b(?:in|during|of) ({'|'.join(MONTHS)})\b(?:,? ((?:19|20)\d\d)\b)?"
UNITS = ["hours", "days", "weeks", "months", "years"]
HOW_LONG = rf"\bhow (?:long|much time|many ({'|'.join(UNITS)}))\b"
YES_NO = r"^\s*(?:did|was|were|is|are|has|have|had|does|do)\b"
SAME = r"\b(?:in|on|during)? ?the same (day|week|month|year) as\b"
#: Words of events that tell none apart.
EMPTY_WORDS = (
    "the a an i you he she it we they me my your his her its our their this that to of in on at for from by with and or did do does was were is are be been has have had "
    "how many long much time days weeks months years hours take took start starting begin ago after before between since until first last"
).split()
#: Words of kinship and keeping, and the relation that each asks for.
RELATIVES = {
    "wife": "spouse", "husband": "spouse", "spouse": "spouse", "son": "parent_of", "daughter": "parent_of", "child": "parent_of", "children": "parent_of",
    "pet": "has_pet", "dog": "has_pet", "cat": "has_pet", "parent": "child_of", "mom": "child_of", "dad": "child_of", "sibling": "sibling_of", "brother": "sibling_of", "sister": "sibling_of",
}
OWN = ["my", "i", "me", "our", "we"]


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def asked_order(text: Column) -> Column:
    """asc for the first, desc for the latest."""
    return F.when(F.lower(text).rlike(FIRST), "asc").when(F.lower(text).rlike(LATEST), "desc")


def asked_bound(text: Column) -> Column:
    return F.when(F.lower(text).rlike(AFTER), "after").when(F.lower(text).rlike(BEFORE), "before")


def asked_month(text: Column, reference: Column) -> Column:
    """(start, end) of a named month: of its own year if it has one, else of the reference's."""
    low = F.lower(text)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), _group(low, IN_MONTH, 1)).cast("int")
    year = F.coalesce(_group(low, IN_MONTH, 2).try_cast("int"), F.year(reference))
    start = F.make_date(year, month, F.lit(1))
    return F.when(month > 0, F.struct(start.alias("start"), F.add_months(start, 1).alias("end")))


def calculation(text: Column) -> Column:
    """(op, anchor, anchor_b, unit, relation) of a question, null if it asks for no calculation.

    op is ago, between, same or allen.  A question for a length of time is never
    one of yes or no, whatever else it says.
    """
    low = F.regexp_replace(F.lower(F.trim(text)), r"[?.! ]+$", "")
    unit = F.coalesce(_group(low, HOW_LONG, 1), F.lit("days"))
    long = low.rlike(HOW_LONG)
    body = F.trim(F.regexp_replace(low, HOW_LONG, ""))
    between, swapped = r"\bbetween (.+?) and (.+)$", r"^(?:before|after|since) (.+?) (?:did|was|were|had) (.+)$"
    sides, yes = r"^(.+?) (?:after|before|prior to|since) (.+)$", rf"{YES_NO} (.+?) (after|before|prior to) (.+)$"
    same = rf"{YES_NO} (.+?) {SAME} (.+)$"
    made = lambda op, a, b=None, relation=None, u=unit: F.struct(F.lit(op).alias("op"), a.alias("anchor"), (F.lit(None).cast("string") if b is None else b).alias("anchor_b"), u.alias("unit"), (F.lit(None).cast("string") if relation is None else relation).alias("relation"))
    none = F.lit(None).cast("string")
    return (
        F.when(long & low.rlike(r"\bago\b"), made("ago", F.trim(F.regexp_replace(body, r"\bago\b", ""))))
        .when(long & body.rlike(between), made("between", _group(body, between, 1), _group(body, between, 2)))
        .when(long & body.rlike(swapped), made("between", _group(body, swapped, 2), _group(body, swapped, 1)))
        .when(long & body.rlike(sides), made("between", _group(body, sides, 1), _group(body, sides, 2)))
        .when(low.rlike(same), made("same", _group(low, same, 1), _group(low, same, 3), none, _group(low, same, 2)))
        .when(~long & low.rlike(yes), made("allen", _group(low, yes, 1), _group(low, yes, 3), F.when(_group(low, yes, 2) == "after", "after").otherwise("before"), none))
    )


def planned(questions: DataFrame) -> DataFrame:
    """Questions (id, user_id, text, now) with their plan: order, bound, status, history, month, calc and the words of its anchors; a leading date mark is their now."""
    now, bare = clock(F.col("text"), F.col("now"))
    rows = questions.select("id", "user_id", now.alias("now"), bare.alias("text"))
    low = F.lower("text")
    plans = rows.select(
        "*", asked_order(low).alias("order"), asked_bound(low).alias("bound"), F.when(low.rlike(FUTURE), "future").alias("status"), F.coalesce(low.rlike(HISTORY), F.lit(False)).alias("history"), asked_month(low, F.col("now")).alias("month"), calculation(F.col("text")).alias("calc")
    )
    said = lambda anchor: F.array_join(event_words(anchor), " ")
    return plans.select("*", F.struct(said(F.col("calc.anchor")).alias("a"), said(F.col("calc.anchor_b")).alias("b")).alias("words"))


def event_words(text: Column) -> Column:
    """The telling words of an event, in base form, each once."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(EMPTY_WORDS))
    return F.array_distinct(F.transform(words, lemma))


def matched(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """(user_id, words, fact_id, event_date): of a user's dated facts (user_id, fact_id, rel_type, object, event_date) the one that shares most of the words, spaced, of each anchor (user_id, words), then the earliest."""
    asked = anchors.distinct().select("user_id", "words", F.explode(F.split("words", " ")).alias("word"))
    said = facts.where("event_date is not null").select("user_id", "fact_id", "event_date", F.explode(event_words(F.concat_ws(" ", F.replace("rel_type", F.lit("_"), F.lit(" ")), "object"))).alias("word"))
    shared = asked.join(said, ["user_id", "word"]).groupBy("user_id", "words", "fact_id", "event_date").agg(F.count("*").alias("n"))
    return shared.groupBy("user_id", "words").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_date", "fact_id")).alias("x")).select("user_id", "words", "x.fact_id", "x.event_date")


def computed(plans: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, op, value, unit, answer, cited_dates, miss): the calculations of planned questions.

    value is in whole units, from the second event to the first (or to now), and
    negative if the first comes earlier; answer is yes or no where that is
    asked.  A miss names the side that has no dated fact in ``answer``.
    """
    asked = plans.where("calc is not null").select("id", "user_id", "now", "calc.*", F.col("words.a").alias("words_a"), F.col("words.b").alias("words_b"))
    anchors = asked.select("user_id", F.explode(F.array("words_a", "words_b")).alias("words")).where("words <> ''")
    dates = staged(matched(anchors, facts), "question-dates").hint("shuffle_hash")  # each key is there once, so that a task holds few
    of = lambda side: dates.select("user_id", F.col("words").alias(f"words_{side}"), F.col("event_date").alias(side))
    met = asked.join(of("a"), ["user_id", "words_a"], "left").join(of("b"), ["user_id", "words_b"], "left")
    lone = F.col("op") == "ago"
    a, b, both = F.col("a"), F.col("b"), F.col("a").isNotNull() & F.col("b").isNotNull()
    met = met.select("*", F.when(lone, F.col("now")).otherwise(a).alias("high"), F.when(lone, a).otherwise(b).alias("low"), (a.isNull() | (~lone & b.isNull())).alias("miss"))
    miss, days = F.col("miss"), F.datediff("high", "low")
    toward_zero = lambda n: F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")
    months = F.months_between("high", "low")
    value = F.when(F.col("unit") == "hours", days * 24).when(F.col("unit") == "days", days).when(F.col("unit") == "weeks", toward_zero(days / 7)).when(F.col("unit") == "months", toward_zero(months)).otherwise(toward_zero(months / 12))
    same = F.coalesce(*[F.when(F.col("unit") == u, F.trunc("a", u if u != "day" else "DD") == F.trunc("b", u)) for u in ("week", "month", "year")], a == b)
    holds = F.when(F.col("op") == "same", same).when(F.col("op") == "allen", F.when(F.col("relation") == "after", a > b).otherwise(a < b))
    lacking = F.concat(F.lit("no date for: "), F.when(a.isNull(), F.col("anchor")).otherwise(F.col("anchor_b")))
    counts = F.col("op").isin("ago", "between")
    cited = F.when(both, F.array(F.least(a, b), F.greatest(a, b))).when(a.isNotNull() | b.isNotNull(), F.array(F.coalesce(a, b))).otherwise(F.array().cast("array<date>"))
    answered = met.select("id", "op", "unit", "miss", "high", "low", counts.alias("counts"), holds.alias("holds"), lacking.alias("lacking"), cited.alias("cited_dates"))
    return answered.select(
        "id", "op", F.when(~miss & F.col("counts"), value.cast("long")).alias("value"), F.when(F.col("counts"), F.col("unit")).alias("unit"),
        F.when(miss, F.col("lacking")).when(F.col("holds"), "yes").when(~F.col("holds"), "no").alias("answer"), "cited_dates", "miss",
    )


def walked(plans: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, position, fact_id, event_date): the user's facts that each planned question without a calculation asks for, in its order.

    The month and the status bound the dates; undated facts come last where no
    month is named, and count as to come.  Only a question of the past sees
    facts that no longer hold (``superseded``); an order gives one fact.
    """
    asked = plans.where("calc is null").select("id", "user_id", "now", "order", "status", "history", "month")
    met = asked.join(facts, "user_id").where("history or not superseded")
    met = met.where(F.col("month").isNull() | ((F.col("event_date") >= F.col("month.start")) & (F.col("event_date") < F.col("month.end"))))
    met = met.where(F.col("status").isNull() | F.col("event_date").isNull() | (F.col("event_date") >= F.col("now")))
    down = F.when(F.col("order") == "desc", F.datediff(F.lit("1970-01-01").cast("date"), "event_date")).otherwise(F.datediff("event_date", F.lit("1970-01-01").cast("date")))
    order = Window.partitionBy("id").orderBy(down.asc_nulls_last(), "fact_id")
    numbered = met.withColumn("position", F.row_number().over(order).cast("long"))
    return numbered.where(F.col("order").isNull() | (F.col("position") == 1)).select("id", "position", "fact_id", "event_date")


def own_entities(questions: DataFrame, facts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, entity): what the words of a question (id, user_id, text) mean among what the user has (user_id, rel_type, object).

    A word of kinship asks for its relation; any other stands for what a name
    (object, display) of the user's holds, or is held by, the first such of each
    relation.
    """
    words = F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda t: F.regexp_replace(t, r"""^[.,!?;:"'()\[\]{}]+|[.,!?;:"'()\[\]{}]+$""", "")), lambda t: (t != "") & ~t.isin(OWN))
    asked = questions.select("id", "user_id", F.explode(F.array_distinct(words)).alias("word"))
    relation = F.try_element_at(F.create_map(*[F.lit(x) for pair in RELATIVES.items() for x in pair]), F.col("word"))
    asked = asked.withColumn("relation", relation)
    held = facts.join(names, "object", "left").select("user_id", "rel_type", F.lower(F.coalesce("display", "object")).alias("entity"))
    kin = asked.where("relation is not null").join(held.withColumnRenamed("rel_type", "relation"), ["user_id", "relation"]).select("id", "entity")
    loose = asked.where("relation is null").join(held, "user_id").where("contains(entity, word) or contains(word, entity)")
    first = loose.groupBy("id", "word", "rel_type").agg(F.min("entity").alias("entity")).select("id", "entity")
    return kin.unionByName(first).distinct()
