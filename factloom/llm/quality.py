"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs hash to ``BUCKETS`` buckets.  Two multinomials over the
buckets, of the trusted target and of the whole corpus, both smoothed by the
share that ``SMOOTH`` counts have in the target, give every bucket a log ratio:
a rare n-gram says little either way.  It is held in millionths as a whole
number so that sums do not depend on their order.  A document's score is the mean over
its n-grams; it is rejected below ``LEAST``.  The table of ratios has BUCKETS
rows at any size of the corpus, which bounds what is broadcast; the trusted
documents' ids are broadcast up to ``BROADCAST_IDS`` and shuffled beyond.  Only
DataFrame functions are used.

Defined cases: null, empty and blank texts have no words and fail the base
rules; without a target every ratio is 0 and the base rules decide alone;
labels of other documents are ignored; every row is judged and counts in the
corpus, so repeated rows are judged alike, and different texts under one doc_id
each by itself; a null doc_id has no label; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.scratch import staged

BUCKETS, SMOOTH, LEAST = 1 << 16, 4.0, -0.15
BROADCAST_IDS = 1 << 20
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside body's own lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(a: Column, n: int) -> Column:
    """The array without its first n items."""
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def _joined(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _pairs(items: Column) -> Column:
    """Hashes of neighbouring items; the last is half a pair."""
    return _joined(items, _tail(items, 1))


def _repeated(items: Column) -> Column:
    """Of the words, those inside windows of five that are found twice or more."""

    def covered(grams: Column) -> Column:
        # The leading bits of a window's hash over its place sort as plain longs; who shares them is then compared whole.
        packed = F.transform(grams, lambda x, i: x.bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long")))
        alike = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
        place = lambda x: x.bitwiseAND(F.lit(PLACES)).cast("int")
        near = lambda s: F.zip_with(s, _tail(s, 1), lambda a, b: F.when(alike(a, b), F.array(place(a), place(b))))
        some = F.array_distinct(F.flatten(F.filter(_let(F.sort_array(packed), near), lambda t: t.isNotNull())))
        every = F.transform(grams, lambda x, i: i)

        def count(places: Column) -> Column:
            rows = F.sort_array(F.transform(places, lambda i: F.struct(F.get(grams, i).alias("x"), i.alias("i"))))
            twins = _let(rows, lambda r: F.zip_with(r, _tail(r, 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"]))))
            starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last"))
            return F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(starts, zero, step, lambda acc: acc["n"]))

        places = F.when(F.size(grams) <= PLACES, some).otherwise(every)
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(places, count))

    def windows(twos: Column) -> Column:
        fives = _let(_joined(twos, _tail(twos, 2)), lambda fours: _joined(fours, _tail(twos, 3)))
        return F.slice(fives, F.lit(1), F.size(twos) - WINDOW + 1)

    few = F.size(items) < WINDOW + 1
    return F.when(few, F.lit(0).cast("long")).otherwise(_let(_pairs(items), lambda twos: _let(windows(twos), covered)))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    fails = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words"))

    return (
        docs.select(
            F.col("doc_id").cast("long"),
            F.xxhash64("text").alias("key"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            _let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.inline(F.array(_let(words(F.col("text")), counts))),
        )
        .withColumn("base_failed", fails)
        .select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    )


def _grams(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, and a row per word and per pair of neighbours: bucket."""
    both = lambda h: F.concat(h, F.slice(_pairs(h), F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))
    rows = docs.select(*columns, F.explode(_let(_hashes(F.col("text")), both)).alias("gram"))
    return rows.select(*columns, F.col("gram").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket"))


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, ratio: log of target over corpus in millionths, for each bucket that the corpus has."""
    mark = trusted.select(F.col("doc_id").cast("long")).distinct().withColumn("good", F.lit(1))
    few = mark.count() <= BROADCAST_IDS
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(mark) if few else mark, "doc_id", "left")
    grams = _grams(marked.withColumn("good", F.coalesce("good", F.lit(0))), "good")
    counts = staged(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")), "quality-counts")
    sums = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    share = lambda n, total, prior: (F.col(n) + prior) / F.col(total)
    raw = share("raw", "raws", SMOOTH * F.col("raws") / F.col("targets"))
    ratio = F.when(F.col("targets") > 0, F.round(F.log(share("target", "targets", F.lit(SMOOTH)) / raw) * 1e6)).otherwise(0.0)
    return counts.crossJoin(F.broadcast(sums)).select("bucket", ratio.cast("long").alias("ratio"))


def judged(docs: DataFrame, trusted: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every document; key is the text's hash."""
    table = staged(ratios(docs, trusted), "quality-ratios")
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    scored = _grams(keyed, "doc_id", "key").join(F.broadcast(table), "bucket").groupBy("doc_id", "key").agg(F.sum("ratio").alias("total"), F.count("*").alias("n"))
    scored = scored.select("doc_id", "key", (F.col("total") / F.col("n") / 1e6).alias("score"))
    base = base_counts(docs).alias("b")
    joined = base.join(scored.alias("s"), F.expr("b.doc_id <=> s.doc_id and b.key = s.key"), "left").select("b.*", F.coalesce("s.score", F.lit(0.0)).alias("score"))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
