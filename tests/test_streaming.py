"""Streams give what the batch operators give, on what the watermark has closed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction, folds, lifecycle, phrases
from factloom.sources import driver_tables as src
from factloom.sources import readers
from factloom.streaming import flows


def log(spark, sf, path):
    src.assertions(spark, sf).repartition(4).write.parquet(path)
    return flows.assertion_stream(spark, path)


def drained(query):
    query.processAllAvailable() if query.isActive else None
    query.awaitTermination(120)


def test_window_counts(spark, sf, tmp_path):
    stream = log(spark, sf, f"{tmp_path}/in")
    drained(flows.append_to(flows.counts(stream, "1 day", late="40 days"), f"{tmp_path}/out", f"{tmp_path}/c1"))
    batch = {(r.start, r.rel_type): r.n for r in lifecycle.window_counts(src.assertions(spark, sf), "1 day").collect()}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        assert batch[(r.start, r.rel_type)] == r.n


def test_first_seen(spark, sf, tmp_path):
    stream = log(spark, sf, f"{tmp_path}/in")
    drained(flows.append_to(flows.first_seen(stream, ["subject", "rel_type", "object"], "60 days"), f"{tmp_path}/out", f"{tmp_path}/c"))
    want = src.assertions(spark, sf).select("subject", "rel_type", "object").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/out").count() == want


def test_maintained_view(spark, sf, tmp_path):
    stream = log(spark, sf, f"{tmp_path}/in")
    drained(flows.maintain(stream, folds.class_max, f"{tmp_path}/kept", f"{tmp_path}/c"))
    views = sorted(tmp_path.glob("kept/view-*"), key=lambda p: int(p.name.split("-")[1]))
    assert spark.read.parquet(str(views[-1])).exceptAll(folds.class_max(src.assertions(spark, sf))).isEmpty()


def test_maintained_view_from_the_last(spark, tmp_path):
    """Three batches, each folded into the view before it."""
    rows = [(1, "a", "r", "x", "C"), (2, "b", "r", "x", "B"), (3, "a", "r", "x", "B"), (4, "b", "r", "x", "C"), (5, "a", "r", "x", "A"), (6, "c", "r", "x", "C")]
    schema = "id long, subject string, rel_type string, object string, fact_class string"
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        drained(flows.maintain(stream, folds.class_max, f"{tmp_path}/kept", f"{tmp_path}/c", refold=True))
    got = {(r.subject, r.fact_class) for r in spark.read.parquet(f"{tmp_path}/kept/view-2").collect()}
    assert got == {("a", "A"), ("b", "B"), ("c", "C")}


def test_hit_lifecycle(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "id long, subject string, rel_type string, object string, ts timestamp"
    files = [[(1, "a", "r", "x", day(0)), (2, "b", "r", "x", day(0))], [(3, "a", "r", "x", day(1)), (4, "a", "r", "x", day(2))], [(5, "z", "r", "x", day(90))], [(6, "z", "r", "y", day(91))]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = flows.append_to(flows.hit_lifecycle(flows.assertion_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c")
        drained(query)
    got = {(r.subject, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "promote"), ("b", "drop")}


@pytest.mark.parametrize("seed", range(3))
def test_hit_lifecycle_is_that_of_the_batch(spark, tmp_path, seed):
    """Random sightings in random batches: the last outcome of each triple is the batch's."""
    rng = random.Random(seed)
    begin = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice("abcdef"), "r", "x", begin + dt.timedelta(days=rng.choice([0, 1, 30, 60, 94, 95, 96, 150]) + rng.random())) for i in range(18)]
    rows += [(100, "g", "r", "x", begin), (101, "g", "r", "x", begin + dt.timedelta(days=95)), (102, "g", "r", "x", begin + dt.timedelta(days=96))]
    schema = "id long, subject string, rel_type string, object string, ts timestamp"
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [[(900 + i, "z", "r", "x", begin + dt.timedelta(days=700 + i))] for i in range(3)]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drained(flows.append_to(flows.hit_lifecycle(flows.assertion_stream(spark, f"{tmp_path}/in"), late="400 days"), f"{tmp_path}/out", f"{tmp_path}/c"))
    until = (begin + dt.timedelta(days=300)).date()  # where the last watermark but one stands
    batch = {r.subject: r.outcome for r in lifecycle.hits(spark.createDataFrame(rows, schema), str(until)).collect()}
    stream = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        stream[r.subject] = "promote" if "promote" in (r.outcome, stream.get(r.subject)) else r.outcome
    assert {s: o for s, o in stream.items() if s != "z"} == {s: o for s, o in batch.items() if o != "keep"}


def test_readers(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "a", "k", True, "x"), ("t1", "b", "k", True, " "), (None, "c", "k", False, "y")], "tenant_id string, cue string, category string, is_active boolean, description string")
    readers.append(rows, f"{tmp_path}/cues", ["category"])
    back = readers.read(spark, f"{tmp_path}/cues")
    assert {r.cue for r in readers.cues(back, "k").collect()} == {"a", "b"}
    assert [r.cue for r in readers.keyed_cues(back, "k").collect()] == ["a"]
    assert readers.ontology(back, None).count() == 1 and readers.ontology(back, "t1").count() == 2
    both = readers.seed_missing(rows.where("tenant_id is null").drop("tenant_id"), rows.where("cue = 'a'"), ["cue"])
    assert {r.cue for r in both.collect()} == {"a", "c"}
    parsed = readers.parsed(spark.createDataFrame([('{"a": 1}',), ("no",)], "j string"), "j", "a int").select(F.col("parsed.a")).collect()
    assert [r.a for r in parsed] == [1, None]


def test_pattern_tables(spark):
    """Active rows that compile, surest first; scalars stay apart."""
    rows = [
        ("likes", r"(\w+) likes (\w+)", 0.5, "compound", True), ("owns", r"(\w+) owns (\w+)", 0.9, None, True), ("bad", "(", 1.0, "compound", True), ("off", "x", 1.0, "compound", False),
        ("ip", r"(\d+)", 1.0, "scalar_atomic", True), ("t", "moved", 0.1, "trigger", True), ("t", "used to", 0.2, "trigger", True), ("none", None, 0.2, "trigger", True),
    ]
    table = spark.createDataFrame(rows, "rel_type string, pattern_regex string, global_confidence double, category string, is_active boolean")
    assert [r for r, _, _ in readers.patterns(table)] == ["owns", "likes", "t", "t"] and [g for _, _, g in readers.patterns(table, ["compound"])] == [2]
    assert readers.matcher(table, "trigger") == "(?:used to)|(?:moved)"
    texts = spark.createDataFrame([(1, "Ann likes Bob. Ann owns Bob! Tea, please"), (2, None), (3, "we MOVED on")], "key int, text string")
    found = extraction.extract(texts, readers.patterns(table))
    assert {(r.subject, r.rel_type, r.object) for r in found.collect()} == {("ann", "owns", "bob")}
    assert extraction.extract(texts, []).count() == 0
    none = spark.createDataFrame([], "phrase string")
    assert {(r.key, r.position) for r in phrases.clauses(texts, none, readers.matcher(table, "trigger")).where("triggered").collect()} == {(3, 0)}
    cues = spark.createDataFrame([("Call ", "a", True), ("call", "b", True), ("x", "a", False), ("", "a", True)], "cue string, category string, is_active boolean")
    assert [r.cue for r in readers.surfaces(cues).collect()] == ["call"]
    dates = spark.createDataFrame([("ago", "relative", 0.1, True), ("soon", "relative", 0.9, True), ("may", "absolute", 0.9, True), ("x", "relative", 1.0, False)], "pattern_regex string, anchor_type string, global_confidence double, is_active boolean")
    assert [r.pattern_regex for r in readers.relative_cues(dates).collect()] == ["soon", "ago"]
