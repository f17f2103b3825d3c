"""Line dedup by an exact set-similarity join.

A line is the set of its words, lowered.  Lines with one set (by a 64-bit hash,
the size and a parity bitmap) form a class, which stands where its first line
stands.  Words are ordered by rarity: how many of
the corpus's words fall in the word's one of ``BUCKETS`` buckets, in powers of
two, then by hash.  Any fixed order makes the prefix filter exact; rarity makes
it sharp.  Two sets with a Jaccard similarity of num/den or more share a word
among the first n - ceil(n num/den) + 1 of either.

A line is removed if an earlier one has the same set or a similar one, so one
earlier similar class is enough to settle a class.  Two steps find it:

1. Every class meets the earliest class that has one of its ``LEADING`` rarest
   words, as far as length, position and the parity bitmaps of the sets allow.
   The best of these is compared on full sets.  This settles the members of a
   group of near copies in linear work.
2. The classes that are still open look among all earlier ones, settled or not,
   by the whole prefix with the same filters.  Full sets decide again, on the
   best candidate of each class first, then on all those of the classes that
   this leaves open.

Full sets are read again from the texts, for the lines of candidates only.  Only
DataFrame functions are used; the rarity table has BUCKETS entries at any size
of the corpus.

Lines are ordered by doc_id (null first), a hash of the row's text, and line
number.  Defined cases: lines without words stay; null text has no lines; empty
text is one empty line; different texts under one doc_id, or under none, are
rows of their own, which text_key tells apart; rows that repeat both doc_id and
text are one row and share its answer; sets of fewer than ``num / (den - num)``
words match equal sets only; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.quality import _let
from factloom.scratch import staged

BUCKETS, LEADING = 1 << 18, 5
HASH_BITS, MOST = 57, 63  # of a word's 64; its rarity, at most 63, goes before them
SPACES = r"[\x09\x0B-\x0D]"  # but line feeds
PLACE = ["doc_id", "text_key", "line_no"]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def _lines(text: Column) -> Column:
    """The lowered lines of a text, with a space for any other white space; most texts need no pattern for it."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\f")
    return F.split(F.when(odd, F.regexp_replace(F.lower(text), SPACES, " ")).otherwise(F.lower(text)), "\n")


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(BUCKETS - 1))


def _rarity(docs: DataFrame) -> DataFrame:
    """One row, levels: for each bucket the power of two of its number of words, in the place that it has in an item."""
    word = docs.select(F.explode(_lines(F.col("text"))).alias("line")).select(F.explode(F.split("line", " ")).alias("word")).where("word <> ''")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("one"))
    counts = word.select(_bucket(F.col("word")).alias("bucket"), F.lit(1).cast("long").alias("one")).union(every).groupBy("bucket").agg(F.sum("one").alias("count"))  # BUCKETS rows
    level = F.when(F.col("bucket") == _bucket(F.lit("")), MOST).otherwise(F.ceil(F.log2(F.col("count") + 1))).cast("long")  # no word is empty
    placed = counts.select(F.shiftleft(F.col("bucket").cast("long"), 6).bitwiseOR(level).alias("x"))
    return staged(placed.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.shiftleft(x.bitwiseAND(F.lit(MOST).cast("long")), HASH_BITS)).alias("levels")), "lines-rarity")


def _ranked(lines: DataFrame, levels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and items: a line's words as longs, rarest first."""
    return lines.select(*keep, "line", levels.scalar().alias("levels")).select(*keep, _items(F.col("line"), F.col("levels")).alias("items"))


def _items(line: Column, levels: Column) -> Column:
    # One pass over the words, as lambdas are not compiled; without nulls, longs are told apart and sorted as such.
    # The levels are named once: a column of their own would be copied for every line.
    rank = lambda level, w: level.bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS))
    ranked = F.transform(F.split(line, " "), lambda w: rank(F.coalesce(F.get(levels, _bucket(w)), F.lit(0).cast("long")), w))
    return F.array_remove(F.sort_array(F.array_distinct(ranked)), rank(F.lit(MOST << HASH_BITS), F.lit("")))


def _parity(items: Column, half: bool) -> Column:
    """A 64-bit parity bitmap of the items, or of the odd ones: two sets differ in at least as many items as their bitmaps in bits."""
    one = (lambda h: h.bitwiseAND(F.lit(1).cast("long"))) if half else (lambda h: F.lit(1).cast("long"))
    # A long is shifted by the last six bits of the hash.
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", one(h), F.hash(h))))


def _classes(docs: DataFrame, levels: DataFrame, num: int, den: int) -> DataFrame:
    """cid and place of the first line of every class, and n, both, high, prefix of its set; an earlier class has a lesser cid."""

    lines = _texts(docs).select("doc_id", "text_key", F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
    prefix = F.slice("items", F.lit(1), (F.size("items") - F.ceil(F.size("items") * num / F.lit(den)) + 1).cast("int"))
    items = F.col("items")
    lines = _ranked(lines, levels, PLACE).select(*PLACE, F.xxhash64("items").alias("key"), F.size("items").alias("n"), _parity(items, False).alias("both"), _parity(items, True).alias("high"), prefix.alias("prefix"))
    first = lines.groupBy("key", "both", "n").agg(F.min(F.struct(*PLACE, "high", "prefix")).alias("x")).select("x.*", "n", "both")
    first = first.where("size(prefix) > 0")  # lines without words go here, where no optimiser moves the test before the costly set
    return staged(first.orderBy(*PLACE).withColumn("cid", F.monotonically_increasing_id()), "lines-classes")


# How many bits tell the bitmaps of a and b apart, those of the odd items and of the others.
APART = "bit_count(a.both ^ a.high ^ b.both ^ b.high) + bit_count(a.high ^ b.high)"


def _reach(num: int, den: int) -> Column:
    """The largest set that length and position (n, pos) allow to be similar."""
    return F.expr(f"least({den}L * n div {num}, {den + num}L * (n - pos) div {num} - n)").cast("int").alias("reach")


def _filters(num: int, den: int) -> str:
    """Reach and parity of a and b (n, reach, both, high) allow the similarity; the cheap tests go first."""
    fewer = f"* {den + num} <= {den - num} * (a.n + b.n)"
    return f"b.n <= a.reach and a.n <= b.reach and bit_count(a.both ^ b.both) {fewer} and ({APART}) {fewer}"


def _sets(docs: DataFrame, levels: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """cid and items of every class in pairs (cid, other), from the text of its first line."""
    wanted = pairs.select("cid").union(pairs.select("other")).distinct()
    places = classes.select("cid", *PLACE).join(wanted, "cid").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line_no", "cid")).alias("at"))
    places = staged(places, "lines-places").hint("shuffle_hash").alias("p")  # the small side; whole texts need no sort
    rows = _texts(docs).alias("d").join(places, F.expr("d.doc_id <=> p.doc_id and d.text_key = p.text_key"))
    picked = _let(_lines(F.col("d.text")), lambda ls: F.transform(F.col("p.at"), lambda x: F.struct(x["cid"].alias("cid"), F.get(ls, x["line_no"]).alias("line"))))
    found = _ranked(rows.select(F.inline(picked)), levels, ["cid"])
    return staged(found.groupBy("cid").agg(F.max("items").alias("items")), "lines-sets")


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The cid of every pair (cid, other) whose full sets have the similarity."""
    both = pairs.join(sets, "cid").join(sets.select(F.col("cid").alias("other"), F.col("items").alias("others")), "other")
    common = both.select("cid", F.size("items").alias("n"), F.size("others").alias("m"), F.size(F.array_intersect("items", "others")).alias("c"))
    return staged(common.where(f"{den} * c >= {num} * (n + m - c)").select("cid").distinct(), "lines-settled")


def _best(pairs: DataFrame) -> DataFrame:
    """The pair of each cid whose bitmaps differ least."""
    return pairs.groupBy("cid").agg(F.min(F.struct("apart", "other")).alias("x")).select("cid", "x.other")


def _survivors(docs: DataFrame, num: int, den: int) -> DataFrame:
    """The place of every line that stays and has words."""
    levels = _rarity(docs)
    classes = _classes(docs, levels, num, den)
    many = classes.where(F.col("n") * (den - num) >= num).select("cid", "n", "both", "high", "prefix")

    leading = many.select("cid", "n", "both", "high", F.posexplode(F.slice("prefix", 1, LEADING)).alias("pos", "h"))
    one = F.struct("cid", "n", _reach(num, den), "both", "high")
    head = F.first(one).over(Window.partitionBy("h").orderBy("cid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    apart = F.expr(APART)
    met = leading.select(one.alias("b"), head.alias("a")).where(f"a.cid < b.cid and {_filters(num, den)}")
    pairs = staged(_best(met.select(F.col("b.cid").alias("cid"), apart.alias("apart"), F.col("a.cid").alias("other"))), "lines-pairs")
    settled = _similar(pairs, _sets(docs, levels, classes, pairs), num, den)

    # A settled class looks for nothing: its id is written as -1 - cid.
    marked = many.join(settled.withColumn("done", F.lit(True)).hint("shuffle_hash"), "cid", "left")
    who = F.coalesce(F.when(F.col("done"), -1 - F.col("cid")).otherwise(F.col("cid")), F.lit(0))  # never null, so that both sides are one shuffle
    postings = marked.select(who.alias("id"), "n", "both", "high", F.posexplode("prefix").alias("pos", "h")).select("id", "n", _reach(num, den), "both", "high", "h")
    a, b = postings.alias("a"), postings.alias("b")
    other = "(a.id ^ shiftright(a.id, 63))"  # -1 - id where that is negative
    met = a.join(b, F.expr(f"a.h = b.h and {other} < b.id and {_filters(num, den)}")).select(F.col("b.id").alias("cid"), F.expr(other).alias("other"), apart.alias("apart"))
    pairs = staged(met.distinct(), "lines-pairs")
    sets = _sets(docs, levels, classes, pairs)
    first = staged(_best(pairs), "lines-best")
    likely = _similar(first, sets, num, den)
    rest = pairs.join(likely, "cid", "left_anti").join(first, ["cid", "other"], "left_anti")
    late = _similar(rest.select("cid", "other"), sets, num, den)
    return classes.select("cid", *PLACE).join(settled.union(likely).union(late).hint("shuffle_hash"), "cid", "left_anti").drop("cid")


def similar_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_key, n_lines, n_removed, removed (the line numbers to leave out) for every row."""
    stay = _survivors(docs, num, den).groupBy("doc_id", "text_key").agg(F.collect_list("line_no").alias("stay"))
    has_word = lambda line: F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.when(has_word(line), i))
    rows = _texts(docs).select("doc_id", "text_key", F.coalesce(numbered, F.expr("cast(array() as array<int>)")).alias("filled"))
    found = rows.alias("d").join(stay.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.text_key = s.text_key"), "left")
    removed = F.array_except(F.array_compact("filled"), F.coalesce("stay", F.expr("cast(array() as array<int>)")))
    found = found.select("d.doc_id", "d.text_key", F.size("filled").cast("long").alias("n_lines"), removed.alias("removed"))
    return found.select("doc_id", "text_key", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents with the lines that ``removed`` (doc_id, text_key, removed) names left out of their texts."""
    marks = removed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed").where("size(removed) > 0").dropDuplicates(["_id", "_key"])
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_id"]) & (F.xxhash64(docs["text"]) == marks["_key"]), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed", i))
    return joined.withColumn("text", F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).drop("_id", "_key", "removed")
