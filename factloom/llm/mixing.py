"""Mixing sources to target weights along a low-discrepancy schedule.

Targets: the sources' weights share all words; a target stops at ``most`` times
its source's size, and the excess is shared again by weight.  Sorted by the
ratio of cap to weight, the sources at their cap are a prefix, which running
sums find without iterating.

Schedule: slot i of at most ``slots`` stands for an equal number of words, a
block.  Its golden-ratio point frac(i * phi) falls into a source's part of the
cumulative targets, and its rank k among the source's slots picks the k-th block
of the source's stream: its documents in the order of a hash of their ids, again
and again.  So the points decide how many blocks a source gives, which by their
low discrepancy is within a few blocks of its target, and where in the mix each
block stands.  Only a source at its cap, whose target is ``most`` times all it
has and may be less than a block, is rounded to its target: blocks beyond it are
left out, and closing slots after the schedule take what is missing.

All ranks and offsets are prefix sums over parts of bounded size, so one large
source is spread over many tasks.  Only DataFrame functions are used.

Defined cases: null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 take 0 words; rows with one doc_id are
documents of their own; an empty table, or one without words, gives targets and
words of 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import staged

WORD = r"[^\x20\x09-\x0D]+"
SLOTS, MOST, CELLS = 1 << 18, 3, 4096
GOLDEN, RING = 2654435769, 1 << 32


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("key"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """A row per source: rank, weight, source_size, target, and its part [low, high) of the ring of points."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    by_ratio = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), "rank")
    capped = F.col("source_size") * most
    sums = (
        sums.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum(capped).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("free", capped * F.col("left_weight") > F.col("left_words") * F.col("weight"))
    )
    everyone = Window.partitionBy()
    first = F.min(F.when(F.col("free"), F.struct(-F.col("left_weight"), "left_words"))).over(everyone)
    sums = sums.withColumn("first", first)
    share = F.col("first.left_words").cast("double") * F.col("weight") / -F.col("first.col1")
    sums = sums.withColumn("target", F.when(F.col("free"), share).otherwise(capped.cast("double")))
    sums = sums.withColumn("quota", F.round("target").cast("long")).withColumn("all", F.sum("quota").over(everyone))
    running = F.sum("quota").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    point = lambda x: F.coalesce(F.floor(F.try_divide(x.cast("double"), F.col("all").cast("double")) * RING), F.lit(0)).cast("long")
    return sums.select("source", "rank", "weight", "source_size", "total", "target", "quota", (~F.col("free")).alias("capped"), point(running - F.col("quota")).alias("low"), point(running).alias("high"))


def _block(slots: int):
    return F.ceil(F.col("total") / F.greatest(F.least("total", F.lit(slots)), F.lit(1))).cast("long")


def schedule(plan: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(rank, k, slot) of every point: slot is the place in the mix, k its number among the source's slots."""
    frame = plan.agg(F.max("total").alias("total")).select(_block(slots).alias("block"), "total")
    frame = frame.withColumn("n", F.ceil(F.col("total") / F.greatest("block", F.lit(1))).cast("long")).where("n > 0")
    cell = RING // CELLS
    parts = F.explode(F.expr("sequence(0L, div(n - 1, 4096L))")).alias("chunk")
    points = frame.select("n", parts).repartition("chunk").select("chunk", F.explode(F.expr("sequence(chunk * 4096L, least(n, (chunk + 1) * 4096L) - 1)")).alias("slot"))
    points = points.withColumn("point", F.col("slot") * F.lit(GOLDEN) % F.lit(RING)).withColumn("cell", F.expr(f"div(point, {cell}L)"))
    cells = plan.where("high > low").select("rank", "low", "high", F.explode(F.expr(f"sequence(div(low, {cell}L), div(high - 1, {cell}L))")).alias("cell"))
    hit = points.join(cells, "cell").where("point >= low and point < high").select("rank", "chunk", "slot")
    held = hit.groupBy("rank", "chunk").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    return hit.withColumn("inside", inside).join(held.withColumn("before", before), ["rank", "chunk"]).select("rank", (F.col("before") + F.col("inside")).alias("k"), "slot")


def _shares(plan: DataFrame, given: DataFrame, slots: int, most: int) -> DataFrame:
    """The plan with each source's block, share (the words its slots take), need (how many slots that is) and got."""
    counts = given.groupBy("rank").agg(F.count("*").alias("got"))
    rows = plan.join(counts, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn("block", _block(slots))
    share = F.when(F.col("capped"), F.col("quota")).otherwise(F.least(F.col("got") * F.col("block"), F.col("source_size") * most))
    return rows.withColumn("share", share).withColumn("need", F.ceil(F.try_divide("share", "block")).cast("long"))


def mix(docs: DataFrame, slots: int = SLOTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, key, source_size, target, taken, first_slot for every document; key is the hash of its text."""
    sizes = staged(sized(docs), "mix-sizes")
    plan = staged(targets(sizes, most), "mix-targets")
    points = staged(schedule(plan, slots), "mix-points")
    shares = staged(_shares(plan, points, slots, most), "mix-shares")
    closing = shares.where("need > got").select("rank", F.explode(F.expr("sequence(got, need - 1)")).alias("k"), F.ceil(F.col("total") / F.col("block")).cast("long").alias("n"))
    taking = points.join(shares.select("rank", "need"), "rank").where("k < need").select("rank", "k", "slot").unionByName(closing.select("rank", "k", (F.col("n") + F.col("k")).alias("slot")))
    known = shares.select("source", "rank", "source_size", "target", "share", "block")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    rows = sizes.join(known, same(sizes, known)).select("doc_id", sizes["source"], "rank", "size", "key", "source_size", "target", "share", "block")
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("order", 1, 3))

    filled = rows.where("size > 0")
    parts = filled.groupBy("rank", "part").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("rank", "part", before.alias("before"))
    inside = Window.partitionBy("rank", "part").orderBy("order", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    stream = filled.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["rank", "part"])
    stream = stream.withColumn("at", F.col("before") + F.col("inner")).drop("before", "inner", "order", "part")

    passes = F.explode(F.expr("sequence(0L, greatest(div(share - 1, source_size), 0L))"))
    turns = stream.withColumn("turn", passes).withColumn("first", F.col("turn") * F.col("source_size") + F.col("at"))
    turns = turns.withColumn("last", F.least(F.col("first") + F.col("size"), F.col("share"))).where("first < last")
    pieces = turns.withColumn("k", F.explode(F.expr("sequence(div(first, block), div(last - 1, block))")))
    pieces = pieces.withColumn("words", F.least("last", (F.col("k") + 1) * F.col("block")) - F.greatest("first", F.col("k") * F.col("block")))
    met = pieces.join(taking, ["rank", "k"]).groupBy("doc_id", "rank", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    facts = ["doc_id", "source", "size", "key", "source_size", "target"]
    joined = stream.alias("s").join(met.alias("m"), F.expr("s.rank = m.rank and s.at = m.at and s.doc_id <=> m.doc_id"), "left")
    taken = joined.select(*[f"s.{c}" for c in facts], F.coalesce("m.taken", F.lit(0)).alias("taken"), "m.first_slot")
    return taken.unionByName(rows.where("size = 0").select(*facts, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot")))
