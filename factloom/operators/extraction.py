"""Facts from text by patterns: what a pattern's groups mean hangs on its relation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The patterns of a small lexicon: relation, pattern, number of groups; surest first.  A tenant's own take their place.
PATTERNS = [
    ("pref_name", r"\b[Mm]y name is ([A-Za-z]+)", 1),
    ("also_known_as", r"\b([A-Za-z]+) goes by ([A-Za-z]+)", 2),
    ("pref_name", r"\b(?:[Aa]|[Tt]he) ([a-z]+) named ([A-Z][a-z]+)", 2),
    ("spouse", r"\b[Mm]y (?:wife|husband|spouse) ([A-Za-z]+)", 1),
    ("age", r"\b[Ii] am ([0-9]{1,3})\b", 1),
    ("age", r"\b([A-Z][a-z]+) is ([0-9]{1,3})\b", 2),
    ("parent_of", r"\b[Mm]y (?:son|daughter|child) ([A-Za-z]+)", 1),
    ("hostname", r"\bhostname is ([a-z0-9-]+)", 1),
    ("works_for", r"\b([A-Za-z]+) works for ([A-Za-z]+)", 2),
    ("related_to", r"\b([A-Za-z]+) (?:works|deals) (?:for|with) ([A-Za-z]+)", 2),
]
STOPWORDS = "the a an and or but is are was were i you he she it we they my your his her our their this that to of in on for with not".split()

#: Relations that give way to others for the same pair, and those that do not.
PRIORITY = {"related_to": 0, "has_spec": 0, "hostname": 1, "fqdn": 1, "ip_address": 1, "instance_of": 1, "has_ram": 1, "has_storage": 1, "expires_on": 1}

#: Signs of a correction; and properties with the relation that they are.
CORRECTIONS = ["actually", "not", "wrong", "incorrect", "innacurate", "update", "sorry", "i meant", "correction", "mistake", "error"]
PROPERTIES = {
    "hostname": "hostname",
    "fqdn": "fqdn",
    "ip": "ip_address",
    "ip address": "ip_address",
    "internal ip": "ip_address",
    "os": "instance_of",
    "operating system": "instance_of",
    "processor": "instance_of",
    "cpu": "instance_of",
    "ram": "has_ram",
    "memory": "has_ram",
    "storage": "has_storage",
    "hard drive": "has_storage",
    "disk": "has_storage",
    "certificate": "expires_on",
}


def _edge(rel: str, groups: int, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Subject, object and validity of a match with groups a and b."""
    word = lambda c: (F.length(c) > 1) & ~F.lower(c).isin(STOPWORDS)
    named = lambda c: word(c) & c.rlike("^[A-Z]")
    user, system = F.lit("user"), F.lit("system")
    if rel in ("also_known_as", "pref_name"):
        return (user, a, word(a)) if groups == 1 else (a, b, word(a) & word(b))
    if rel in ("spouse", "parent_of"):
        return user, a, named(a)
    if rel == "age":
        return (user, a, F.lit(True)) if groups == 1 else (a, b, named(a))
    return (system, a, F.length(a) > 1) if groups == 1 else (a, b, (F.length(a) > 1) & (F.length(b) > 1))


def needed(pattern: str) -> str | None:
    """Plain characters that every match of a pattern holds, null where no simple look at it finds any."""
    if re.search(r"\||\(\?(?!:)|\)[?*{]|\\[A-Zace-mopquvxyz0-9\[\]]|\[\^?\]", pattern.replace(r"\B", r"\b")):
        return None
    plain = re.sub(r"\[[^\[\]]*\]", "\0", re.sub(r"\\.", "\0", pattern))
    if re.search(r"[\[\]\\]", plain):
        return None
    plain = re.sub(r"\(\?:|[()]", "", plain)
    plain = re.sub(r"([?*+}])[?+]", r"\1", plain)
    plain = re.sub(r"[^\0][?*]|[^\0]\{[^}]*\}", "\0", plain)
    runs = re.findall(r"[A-Za-z0-9 _@:/-]+", re.sub(r"\{[^}]*\}", "\0", plain))
    return max((r for r in runs if len(r) > 1), key=len, default=None)


def extract(texts: DataFrame, patterns: list[tuple[str, str, int]] = PATTERNS) -> DataFrame:
    """(key, subject, rel_type, object, is_preferred_label, is_correction) of every match in the texts (key, text).

    Of the relations of one pair the one of highest priority stays, the surest
    pattern's among equals.  A table of patterns comes in through
    ``readers.patterns``; patterns without a group state no object and are passed
    over.
    """
    patterns = [p for p in patterns if p[2]]
    none = F.expr("cast(array() as array<string>)")

    def edges(place: int, rel: str, pattern: str, groups: int) -> Column:
        held = needed(pattern)  # no pattern runs over a text that cannot match
        may = F.contains(F.col("text"), F.lit(held)) if held else F.col("text").rlike(pattern)
        found = lambda g: F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(g))).otherwise(none)

        def made(x: Column) -> Column:
            subject, obj, good = _edge(rel, groups, x["a"], x["b"])
            return F.when(good, F.struct(F.lower(subject).alias("subject"), F.lit(rel).alias("rel_type"), F.lower(obj).alias("object"), F.lit(place).alias("place")))

        return F.filter(F.transform(F.arrays_zip(found(1).alias("a"), found(groups).alias("b")), made), lambda x: x.isNotNull())

    every = [edges(place, *pattern) for place, pattern in enumerate(patterns)]
    if not every:
        every = [F.expr("cast(array() as array<struct<subject string, rel_type string, object string, place int>>)")]
    signal = F.coalesce(F.lower("text").rlike("|".join(CORRECTIONS)), F.lit(False))
    rows = texts.select("key", signal.alias("is_correction"), F.inline(F.flatten(F.array(*every))))
    rank = F.coalesce(*[F.when(F.col("rel_type") == r, F.lit(n)) for r, n in PRIORITY.items()], F.lit(0))
    best = F.min_by("rel_type", F.struct(-rank, "place"))
    return rows.groupBy("key", "subject", "object").agg(best.alias("rel_type"), F.first("is_correction").alias("is_correction")).withColumn("is_preferred_label", F.col("rel_type") == "pref_name")


def property_relation(name: Column) -> Column:
    """The relation of a property's name, or of the first known name in it, else related_to."""
    key = F.lower(F.trim(name))
    exact = [F.when(key == known, F.lit(rel)) for known, rel in PROPERTIES.items()]
    within = [F.when(F.contains(key, F.lit(known)), F.lit(rel)) for known, rel in PROPERTIES.items()]
    return F.coalesce(*exact, *within, F.lit("related_to"))


def _unclaimed(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """The edges of ``unclaimed``; n: how many edges are equal to it in key, object and relation, place: its place among them."""
    both = edges.withColumn("is_claim", F.lit(False)).unionByName(claims.select("key", F.col("value").alias("object"), "rel_type", F.lit(True).alias("is_claim")), allowMissingColumns=True)
    # One order serves both windows, so the rows are dealt and sorted once.
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    claimed = F.max("is_claim").over(Window.partitionBy("key", "object").orderBy("rel_type", "is_claim").rowsBetween(*whole))
    same = Window.partitionBy("key", "object", "rel_type").orderBy("is_claim")
    met = both.withColumn("claimed", claimed).select("*", F.max("is_claim").over(same.rowsBetween(*whole)).alias("own"), F.count_if(~F.col("is_claim")).over(same.rowsBetween(*whole)).alias("n"), F.row_number().over(same).alias("place"))
    free = ~F.col("claimed") | (F.col("own") & F.col("rel_type").isNotNull()) | F.col("key").isNull() | F.col("object").isNull()
    return met.where(~F.col("is_claim") & free)


def unclaimed(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges (key, rel_type, object) without those whose object is exactly a claimed value of their text under another relation."""
    return _unclaimed(edges, claims).select(*edges.columns)


def unclaimed_counts(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(key, rel_type, object, n): the edges of ``unclaimed``, each once, with how many there are of it."""
    return _unclaimed(edges.select("key", "rel_type", "object"), claims).where("place = 1").select("key", "rel_type", "object", "n")
