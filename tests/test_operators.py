"""Golden cases of operators whose inputs the driver tables do not have."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from factloom.operators import dates, extraction, filters, folds, gate, graphs, lifecycle, rendering, temporal, texts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_uuid5(spark):
    for name in ("a", "user", "Zürich"):
        assert one(spark, texts.uuid5(str(uuid.NAMESPACE_DNS), F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


@pytest.mark.parametrize("word,want", [("IP", "an"), ("SSD", "an"), ("MRI", "an"), ("URL", "a"), ("UUID", "a"), ("5G", "a"), ("dog", "a"), ("apple", "an")])
def test_article(spark, word, want):
    assert one(spark, rendering.article(F.lit(word))) == want


@pytest.mark.parametrize("text,want", [("you are here", "you are not here"), ("it is not so", "it is not so"), ("", ""), ("she sings", "it is not the case that she sings"),
    ("You have a pet that is Dog", "You do not have a pet that is Dog"), ("Diane lives in Toronto", "Diane does not live in Toronto"), ("You had a pet", "You did not have a pet"),
    ("The gps system is functioning", "The gps system is not functioning"), ("You have eaten lunch", "You have not eaten lunch"), ("You will attend the meeting", "You will not attend the meeting"),
    ("You are not sick", "You are not sick"), ("Diane lived in Toronto", "Diane did not live in Toronto"), ("You carried the box", "You did not carry the box"), ("Diane went to Toronto", "Diane did not go to Toronto"),
    ("Diane goes to school", "Diane does not go to school"), ("diane lives in toronto", "diane does not live in toronto"), ("marcus works for acme", "marcus does not work for acme"), ("sarah dislikes cilantro", "sarah does not dislike cilantro"),
    ("apollo ip address 10.0.0.4", "it is not the case that apollo ip address 10.0.0.4"), ("you favorite color teal", "it is not the case that you favorite color teal"), ("apollo ports 80", "it is not the case that apollo ports 80"),
])
def test_negation(spark, text, want):
    assert one(spark, rendering.negated(F.lit(text))) == want


def test_templates(spark):
    fill = lambda t: one(spark, rendering.sentence(F.lit(t), F.lit("has_pet"), F.lit("you"), F.lit("Rex")))
    assert fill("{x} own {y} (a hint)") == "you own Rex"
    assert fill("(only a hint)") == "(only a hint)"
    assert fill(None) == "you has pet Rex"
    both = lambda second, you: one(spark, rendering.sentence(F.lit("{x} likes {y}"), F.lit("likes"), F.lit("you"), F.lit("tea"), F.lit(second).cast("string"), F.lit(you)))
    assert (both("You like {y}", True), both("You like {y}", False), both(None, True)) == ("You like tea", "you likes tea", "you likes tea")


def test_named_days(spark):
    day = lambda name, on: one(spark, temporal.named_day(name, F.lit(on).cast("date")))
    assert day("thanksgiving", "2023-12-01") == dt.date(2023, 11, 23)
    assert day("thanksgiving", "2023-11-22") == dt.date(2022, 11, 24)
    assert day("memorial_day", "2023-06-01") == dt.date(2023, 5, 29)
    assert day("christmas", "2023-12-25") == dt.date(2023, 12, 25)


def test_windows_and_durations(spark):
    day = F.lit("2023-03-10").cast("date")
    start, end = temporal.calendar_window(day, "month", -1)
    assert (one(spark, start), one(spark, end)) == (dt.date(2023, 2, 1), dt.date(2023, 3, 1))
    assert one(spark, temporal.week_start(day, 6)) == dt.date(2023, 3, 5)
    d = lambda x: F.lit(x).cast("date")
    least, most = temporal.duration(d("2023-02-15"), d("2023-02-16"), d("2023-03-01"), d("2023-03-02"))
    assert (one(spark, least), one(spark, most)) == (14, 14)


def test_class_never_falls_and_provenance_ratchets(spark):
    rows = [(1, "u", "likes", "x", 1, 0.9, "B", "user_stated"), (2, "u", "likes", "x", 2, 0.2, "C", "llm_inferred")]
    log = spark.createDataFrame(rows, "id long, subject string, rel_type string, object string, ts long, confidence double, fact_class string, provenance string")
    row = folds.triple_upsert(log).first()
    assert (row.fact_class, row.provenance, row.confidence, row.unified_confidence, row.confirmed_count) == ("B", "user_stated", 0.9, 0.2, 2)


def test_unified_confidence(spark):
    value = lambda who, c, f: one(spark, gate.unified_confidence(F.lit(who), F.lit(c), F.lit(f), F.lit(3.0)))
    assert value("user", 0.1, 0.0) == 1.0
    assert value("engine", 0.5, 0.0) == pytest.approx(0.3)
    assert value("llm", 0.8, 6.0) == pytest.approx(0.9)


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(13)) + " " + "x" * 1500 + "."
    rows = texts.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("position").collect()
    assert [len(r.chunk.split(". ")) for r in rows] == [6, 6, 1, 1]
    assert {r.doc_id for r in rows} == {1} and not any(r.truncated for r in rows)


def test_token_bucket(spark):
    rows = [(i, "a", dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate([0, 0, 0, 1, 5])]
    log = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = [(r.left, r.wait) for r in lifecycle.token_bucket(log, "k", 1.0, 2.0).orderBy("id").collect()]
    # The fourth call comes while the third still waits for the token of its second, so it waits for the next.
    assert got == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (1.0, 0.0)]


def test_token_bucket_never_overspends(spark):
    """One call a second: six calls within the first second are served one second apart."""
    at = [0, 0.1, 0.2, 0.3, 0.4, 1.0]
    rows = [(i, "a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate(at)]
    got = [r.wait for r in lifecycle.token_bucket(spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz"), "k", 1.0, 1.0).orderBy("id").collect()]
    assert got == pytest.approx([0.0, 0.9, 1.8, 2.7, 3.6, 4.0])


def test_claims_stand_for_the_window(spark):
    """Six events 200 s apart and a window of 300 s: every second one is admitted; a correction takes a plain claim's place."""
    rows = [(i, "a", "c" if i == 3 else "s", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=200 * i)) for i in range(6)]
    log = spark.createDataFrame(rows, "id long, k string, intent string, ts timestamp_ntz")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(lifecycle.dedup_window(log, ["k"], 300)) == [0, 2, 4]
    assert ids(lifecycle.dedup_window(log, ["k"], 300, F.col("intent") == "c")) == [0, 2, 3, 5]


def test_hits_follow_their_days(spark):
    """Idle days end a triple before the next sighting creates it anew."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    cases = {"anew": [0, 95, 96], "gone": [0], "done": [0, 1, 2], "once": [0, 31]}
    rows = [(i, "u", "r", name, day(n)) for name, days in cases.items() for i, n in enumerate(days)]
    log = spark.createDataFrame(rows, "id long, subject string, rel_type string, object string, ts timestamp_ntz")
    got = {r.object: (r.hits, r.outcome) for r in lifecycle.hits(log, "2024-04-06").collect()}
    assert got == {"anew": (2, "keep"), "gone": (0, "drop"), "done": (3, "promote"), "once": (0, "drop")}


def test_breaker_and_budget(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = [(0, True), (1, True), (2, True), (3, False), (61, True), (62, True), (63, False), (122, False), (123, True)]
    log = spark.createDataFrame([(i, "e", bad, at(s)) for i, (s, bad) in enumerate(calls)], "id long, k string, bad boolean, ts timestamp_ntz")
    got = [(r.passed, r.failures) for r in lifecycle.circuit_breaker(log, "k", F.col("bad")).orderBy("id").collect()]
    assert got == [(True, 1), (True, 2), (True, 3), (False, 3), (False, 3), (True, 4), (False, 4), (True, 0), (True, 1)]
    spent = [(r.granted, r.used) for r in lifecycle.daily_budget(log, "k", 2, 60, F.col("id") == 3).orderBy("id").collect()]
    assert spent == [(True, 1), (True, 2), (False, 2), (True, 3), (True, 1), (True, 2), (False, 2), (True, 1), (True, 2)]


def test_shape_and_keys(spark):
    rows = spark.createDataFrame([("a", None, "r"), ("a", "b", "r")], "subject string, object string, rel_type string")
    assert [r.missing for r in gate.shape_error(rows).collect()] == ["object", None]
    assert one(spark, texts.synonym_key(F.lit("The Ex-wife's"))) == "ex wife"
    assert one(spark, texts.relation_name(F.lit("is the Best friend of"))) == "best_friend_of"
    assert one(spark, texts.sentences(F.lit("One here. Two!  Three"))) == ["One here.", "Two!", "Three"]


def test_sentences_keep_their_digits(spark):
    text = "Of. 1 a.  2 b 2. 33. \n4 d 4. d\n"
    assert one(spark, texts.sentences(F.lit(text))) == ["Of.", "1 a.", "2 b 2.", "33.", "4 d 4.", "d\n"]
    assert one(spark, texts.sentences(F.lit(" a. 1.  "))) == ["a.", "1."]
    docs = spark.createDataFrame([(1, "Term. 1 is not three words 1. 22 2")], "doc_id long, text string")
    parts = docs.select("doc_id", F.posexplode(texts.sentences(F.col("text"))).alias("position", "sentence"))
    found = texts.unmatched(parts, spark.createDataFrame([(1, "term")], "doc_id long, term string"))
    assert [r.sentence for r in found.collect()] == ["1 is not three words 1."]
    assert [r.chunk for r in texts.chunks(spark.createDataFrame([(1, "One. " * 303 + "3 is three.")], "doc_id long, text string")).collect()][-1].endswith("One. 3 is three.")


def test_query_without_its_leading_word(spark):
    """The leading word ends at the first space, whatever white space is in it."""
    assert one(spark, filters.query_variants(F.lit("Our.\nTown is on the map"))) == ["Our.\nTown is on the map", "is on the map"]


def test_taxonomies_meet_counted_relations(spark):
    """Edges are counted before they meet the taxonomies, so that no task holds all edges of a relation."""
    taxonomies = spark.createDataFrame([("t", ["r", "q"]), ("u", ["r"]), ("v", [])], "taxonomy string, defining_rels array<string>")
    edges = spark.createDataFrame([("a", "r", "b")] * 3 + [("a", "q", "b"), ("a", "other", "b")], "subject string, rel_type string, object string")
    found = graphs.taxonomy_bridge(taxonomies, edges)
    assert sorted(tuple(r) for r in found.collect()) == [("t", "q", 1), ("t", "r", 3), ("u", "r", 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Join")


def test_needed_characters_of_patterns(spark):
    """Texts without them are not searched; patterns that show none are searched everywhere."""
    want = {r"\b(fundamental) ([a-z]+)\b": "fundamental ", r"[Mm]y name is (.)": "y name is ", "c(ab)+d": "cab", "ab?cd": "cd", "ab*?cde": "cde", "a{0,2}bcd": "bcd", "(ab)?(.)": None, "ab|(c)": None, "(?i)(abc)": None, r"\x41b(c)": None, "[]a]b(c)": None, "a(.)": None}
    assert {p: extraction.needed(p) for p in want} == want
    texts_ = spark.createDataFrame([(1, "xcababd ABC acd"), (2, "none"), (3, None), (4, "a fundamental change")], "key long, text string")
    patterns = [("r", r"(c)(ab)+d", 1), ("s", "(?i)(abc)", 1), ("t", r"\b(fundamental) ([a-z]+)\b", 2), ("u", "(a|x)b?c", 1)]
    got = sorted((r.key, r.rel_type, r.subject, r.object) for r in extraction.extract(texts_, patterns).collect())
    assert got == [(1, "s", "system", "abc"), (4, "t", "fundamental", "change")]


def test_recall_is_whole(spark):
    rows = [("u", f"fact {i}", "C" if i % 3 else "A", (i * 37 % 200) / 200) for i in range(200)] + [("u", "fact 0", "C", 2.0), ("u", "odd", None, None), ("v", None, "A", 0.5)]
    blocks = {r.u: r.block for r in rendering.recall(spark.createDataFrame(rows, "u string, text string, fact_class string, confidence double"), "u").collect()}
    best = {}
    for _, text, kind, confidence in rows[:-1]:
        held = best.get(text, (True, float("-inf")))
        best[text] = (held[0] and kind == "C", max(held[1], float("-inf") if confidence is None else confidence))
    order = sorted(best, key=lambda t: (best[t][0], -best[t][1], t))
    asserted, tentative = [f"- {t}" for t in order if not best[t][0]], [f"- {t}" for t in order if best[t][0]]
    assert blocks == {"u": "\n".join([*asserted, "Perhaps:", *tentative]), "v": rendering.EMPTY}
    few = rendering.recall(spark.createDataFrame(rows, "u string, text string, fact_class string, confidence double"), "u", most=50).where("u = 'u'").first()
    assert few.block == "\n".join(asserted[:50])


def test_recall_events(spark):
    day = dt.date
    rows = [("u", "b came", "C", 0.1, day(2024, 1, 5)), ("u", "a came", "A", 0.9, day(2024, 3, 1)), ("u", "b came", "A", 0.2, None), ("u", "is here", "A", 0.3, None), ("u", "may go", "C", 0.3, None)]
    got = rendering.recall(spark.createDataFrame(rows, "u string, text string, fact_class string, confidence double, day date"), "u", date="day").first().block
    assert got == "In order:\n1. [2024-01-05] b came\n2. [2024-03-01] a came\n- is here\nPerhaps:\n- may go"


def test_chunks_are_whole(spark):
    import re

    def plain(text):
        split = lambda t: [s for s in re.split(r"(?<=[.!?])\s+", t) if s]
        pieces, out = [], []
        for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
            if len(p) <= 1200:
                pieces.append([p])
                continue
            held = []
            for s in split(p):
                if held and (len(held) == 6 or len(" ".join([*held, s])) + 1 > 1200):
                    pieces.append([" ".join(held)])
                    held = []
                held.append(s)
            pieces.append([" ".join(held)])
        for (p,) in pieces:
            n = len(split(p))
            if out and out[-1][1] < 2 and out[-1][1] + n <= 6 and len(out[-1][0]) + len(p) + 4 <= 1200:
                out[-1] = (out[-1][0] + "\n\n" + p, out[-1][1] + n)
            else:
                out.append((p, n))
        return [c for c, _ in out]

    long = " ".join(f"Sentence number {i} of a long text is here." for i in range(1600))
    mixed = "A heading\n\nOne here. Two there.\n \nAlone.\n\n" + " ".join(["Nine."] * 9) + "\n\n" + "y" * 1190 + ".\n\nTail.\n\n" + " ".join(f"Part {i} {'z' * 300}." for i in range(9)) + "\n\nEnd.\n"
    rows = texts.chunks(spark.createDataFrame([(1, long), (2, mixed)], "doc_id long, text string")).orderBy("doc_id", "position").collect()
    got = {d: [(r.position, r.chunk) for r in rows if r.doc_id == d] for d in (1, 2)}
    assert got == {1: list(enumerate(plain(long))), 2: list(enumerate(plain(mixed)))}
    assert len(got[1]) > 260 and all(r.truncated == (r.position >= 200) for r in rows)
    assert got[2][0][1] == "A heading\n\nOne here. Two there."


def test_barrier_gives_shed_work_no_slot(spark):
    """One slot and half an hour of work each, at minutes 0, 10, 25, 35, 50 and 60; five minutes' grace, then none."""
    import datetime as dt

    rows = [(i, "k", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, m in enumerate([0, 10, 25, 35, 50, 60])]
    log = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: (r.admitted, r.waited, r.busy) for r in lifecycle.admitted(log, "k", 1800, 1, 300).collect()}
    assert got == {0: (True, 0.0, 0), 1: (False, None, 1), 2: (True, 300.0, 1), 3: (False, None, 1), 4: (False, None, 1), 5: (True, 0.0, 0)}
    assert [r.admitted for r in lifecycle.admitted(log, "k", 1800, 1, 0).orderBy("id").collect()] == [True, False, False, True, False, False]


def test_concurrency_over_midnight(spark):
    rng = __import__("random").Random(5)
    start = dt.datetime(2024, 1, 1, 20)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(30 * 3600))) for i in range(1500)] + [(2000 + i, dt.datetime(2024, 1, 1, 23, 59, 59)) for i in range(40)]
    log = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    marks = sorted([(t, 1, i) for i, t in rows] + [(t + dt.timedelta(seconds=1800), -1, i) for i, t in rows])
    for restart in (False, True):
        want, busy, of = {}, {}, dict(rows)
        for _, step, i in marks:
            day = of[i].date()
            run = day if restart else None
            busy[run] = busy.get(run, 0) + step
            if step == 1:
                peak, shed = want.get(day, (0, 0))
                want[day] = (max(peak, busy[run]), shed + (busy[run] > 26))
        assert {r.day: (r.peak, r.shed) for r in lifecycle.concurrency(log, 1800, 26, restart).collect()} == want


@pytest.mark.parametrize(
    "text,want",
    [("you's preferred name is Chris", "your preferred name is Chris"), ("you is the parent of Cyrus", "you are the parent of Cyrus"), ("you was born in Guelph", "you were born in Guelph"), ("you likes Art", "you likes Art"), ("", "")],
)
def test_agreement(spark, text, want):
    assert one(spark, rendering.agreed(F.lit(text))) == want


def test_titled(spark):
    assert one(spark, rendering.titled(F.lit("sarah knows sarahjane"), F.array(F.lit("sarah"), F.lit("sarahjane")))) == "Sarah knows Sarahjane"
    assert one(spark, rendering.titled(F.lit("you are tired"), F.array(F.lit("you")))) == "you are tired"


def test_clauses(spark):
    clause = lambda rel, obj, kind, verb, you=True: one(spark, rendering.object_clause(F.lit(rel), F.lit("you" if you else "rex"), F.lit(obj), F.lit(kind), F.lit(you), F.lit(verb), F.lit(True), F.lit(False)))
    assert clause("has_pet", "fraggle", "dog", "have") == "you have a dog named fraggle"
    assert clause("owns", "apollo", "server", "own") == "you own a server named apollo"
    assert clause("has_pet", "dog", "dog", "have") is None
    assert clause("instance_of", "dog", None, None, you=False) == "rex is a dog"


REFERENCE = dt.date(2023, 4, 12)


@pytest.mark.parametrize(
    "text,status,day",
    [
        ("I fixed the fence three weeks ago", "past", dt.date(2023, 3, 22)),
        ("I trimmed the hooves two weeks ago", "past", dt.date(2023, 3, 29)),
        ("I called the vet yesterday", "past", dt.date(2023, 4, 11)),
        ("I am moving today", "now", dt.date(2023, 4, 12)),
        ("the appointment is tomorrow", "future", dt.date(2023, 4, 13)),
        ("I will move in two weeks", "future", dt.date(2023, 4, 26)),
        ("the outage was 2 days ago", "past", dt.date(2023, 4, 10)),
        ("a couple of months ago I adopted a cat", "past", dt.date(2023, 2, 12)),
        ("I saw him last Thursday", "past", dt.date(2023, 4, 6)),
        ("the meeting is next Thursday", "future", dt.date(2023, 4, 13)),
        ("a while ago I moved to Calgary", "now", None),
        ("I changed jobs recently", "now", None),
        ("that happened long ago", "now", None),
        ("I will move next month", "now", None),
        ("I will note the outage was on 2001-01-01", "past", dt.date(2001, 1, 1)),
    ],
)
def test_relative_dates(spark, text, status, day):
    row = spark.range(1).select(dates.status(F.lit(text), F.lit(REFERENCE)).alias("s"), dates.point(F.lit(text), F.lit(REFERENCE)).alias("d")).first()
    assert (row.s, row.d) == (status, day)


def test_named_days_and_offsets(spark):
    at = F.lit(dt.date(2023, 5, 10))
    day = lambda f, text: one(spark, f(F.lit(text), at))
    assert day(dates.event_date, "Black Friday") == dt.date(2022, 11, 25)
    assert day(dates.offset_date, "a week before Black Friday") == dt.date(2022, 11, 18)
    assert day(dates.event_date, "fence") is None and day(dates.offset_date, "a week before the fence") is None
    assert one(spark, dates.window(F.lit("last week"), at)["start"]) == dt.date(2023, 5, 1)
    assert one(spark, dates.window(F.lit("last week"), at, 6)["start"]) == dt.date(2023, 4, 30)
    for text, want in (("two weeks ago", True), ("yesterday", True), ("last thursday", True), ("2020-03-22", True), ("brown swiss", False), ("fence", False), ("", False)):
        assert one(spark, dates.is_temporal(F.lit(text))) == want
    point = lambda d: (F.lit(d), F.date_add(F.lit(d), 1))
    assert one(spark, dates.gap(*point(dt.date(2023, 2, 15)), *point(dt.date(2023, 3, 1)))["exact"]) == 14
    assert one(spark, dates.gap(*point(dt.date(2023, 3, 1)), *point(dt.date(2023, 2, 15)))["exact"]) == -14
    assert dates.union_of(["a", "(", "b"]) == "(?:a)|(?:b)"


def test_an_offset_runs_its_pattern_once_over_a_text(spark):
    texts = ["we met\nA  week before  Black Friday sales", "2 fortnights AFTER christmas\n", "a week before Halloween\nnothing", "before", "an hour after christmas", "", None]
    rows = spark.createDataFrame([(i, t, dt.date(2023, 5, 10)) for i, t in enumerate(texts)], "i int, text string, day date")
    found = rows.select("i", dates.offset_date(F.col("text"), F.col("day")).alias("d"), dates.resolved(F.col("text"), F.col("day")).alias("r"))
    got = [(r.d, r.r and r.r.how) for r in found.orderBy("i").collect()]
    assert got == [(dt.date(2022, 11, 18), "offset"), (dt.date(2023, 1, 22), "offset"), (None, "named"), (None, None), (None, "named"), (None, None), (None, None)]
    plan = rows.select(dates.offset_date(F.col("text"), F.col("day")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("prior\\s+to") <= 5  # over the text once, over what it matched once a group


def test_unclaimed_edges_are_dealt_and_sorted_once(spark):
    rows = [(1, "a", 5), (1, "a", 5), (1, "b", 5), (1, None, 5), (1, "a", 6), (None, "a", 5), (2, "a", None), (3, "b", 7), (3, None, 7)]
    edges = spark.createDataFrame(rows, "key int, rel_type string, object int").withColumn("more", F.lit("x"))
    claims = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "b", 5), (2, "b", None), (3, None, 7)], "key int, rel_type string, value int")
    shown = lambda found: sorted((r.key or 0, r.rel_type or "", r.object or 0) for r in found)
    kept = [(0, "a", 5), (1, "a", 5), (1, "a", 5), (1, "a", 6), (2, "a", 0)]
    whole = extraction.unclaimed(edges, claims)
    assert whole.columns == edges.columns and shown(whole.collect()) == kept
    counts = extraction.unclaimed_counts(edges, claims)
    assert shown(counts.collect()) == sorted(set(kept)) and {r.n for r in counts.collect() if r.object == 5 and r.key == 1} == {2}
    plan = extraction.unclaimed_counts(edges, claims)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan
