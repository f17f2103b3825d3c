"""Relation phrases, phrases of a lexicon, lifted edges and pronouns, against values written by hand and plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import decomposers, lifts, mentions, morphology, phrases, replies


def applied(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


LEMMAS = {
    "had": "have", "born": "bear", "went": "go", "named": "name", "scheduled": "schedule", "vaccinated": "vaccinate", "automated": "automate", "loving": "love", "serving": "serve", "argued": "argue",
    "used": "us", "dances": "dance", "changing": "chang", "visited": "visit", "walking": "walk", "played": "play", "pulled": "pull", "married": "marry", "studies": "study", "watches": "watch",
    "boxes": "box", "potatoes": "potato", "glass": "glass", "bus": "bus", "died": "di", "ties": "ty", "eats": "eat", "king": "king", "red": "red", "being": "be", "xyz": "xyz", "": "",
}


def test_lemmas(spark):
    assert dict(zip(LEMMAS, applied(spark, LEMMAS, morphology.lemma))) == LEMMAS


FORMS = {
    "had an issue with": "has_issue", "lives in": "live_in", "is living in": "live_in", "Was born in": "bear_in", "works for": "work_for", "I've bought": "has_buy", "they're running": "run",
    "the": "the", "the a my": "my", "ve": "has", "ll": "will", "s": "", "t re": "", "": "", "  !! ": "", "married to": "marry_to", "made a cake": "makes_cake", "will be visiting the": "visit",
    "had_an_issue": "has_issue", "lives at": "live_at", "is": "be", "would have to": "has", "giving the dog a bone": "gives_dog", "gave the dog": "gave_dog", "my brother works with": "brother_work_with", "to": "to",
    "talked to him about": "talk_to_him_about", "is a friend of": "a_friend_of", None: "",
}


def test_normal_forms(spark):
    assert dict(zip(FORMS, applied(spark, FORMS, morphology.normal_form))) == FORMS


def test_all_twelve_prepositions_stay(spark):
    assert applied(spark, [f"stands {p} the" for p in morphology.PREPOSITIONS], morphology.normal_form) == [f"stand_{p}" for p in morphology.PREPOSITIONS]
    assert len(morphology.PREPOSITIONS) == 12


def test_fold_meets_seeded_relations_only(spark):
    seeded = spark.createDataFrame([("lives_in",), ("works_for",), ("WORKED_FOR",)], "rel_type string")
    said = spark.createDataFrame([("living in",), ("lives_in",), ("worked for",), ("flies to",), ("",)], "surface string")
    found = {r.surface: (r.normal, r.rel_type) for r in morphology.fold_onto_seeded(said, seeded).collect()}
    assert found == {"living in": ("live_in", "lives_in"), "lives_in": ("live_in", None), "worked for": ("work_for", "worked_for"), "flies to": ("fly_to", None), "": ("", None)}


BETWEEN = {
    "fixed the": "fix", "had an issue with the": "has_issue", "just lives in": "live_in", "is": None, "the": None, "three weeks ago": None, "2nd": None, "wants to": None, "named": None, "called": None,
    "called for": "call_for", "thinking of": None, "is planning to": "plann_to", "hopes for": None, "likes": "like", "likes to": None, "and": None, "finally bought a big": "buy", "has been working on": "has_work",
    "was": None, "made": "makes", "have": "has", "'s": None, "don't": "don", "met up with": "meet", "": None, "really": None, "her": None,
}


def test_predicates_between_mentions(spark):
    assert dict(zip(BETWEEN, applied(spark, BETWEEN, lambda c: lifts.predicate(phrases.tokens(c))))) == BETWEEN


def test_content_verbs_only(spark):
    got = applied(spark, ["had an issue with", "is near", "fixed", "lives in", "gives a", "is"], lambda c: lifts.predicate(phrases.tokens(c), content_verbs_only=True))
    assert got == [None, "near", "fix", "live_in", None, None]


def test_edges_bind_neighbours_only(spark):
    text = "I fixed the fence where my goats graze and Ann visited Bob"
    parts = spark.createDataFrame([(1, text)], "key int, text string").select("key", "text", phrases.tokens(F.col("text")).alias("tokens"))
    names = spark.createDataFrame([(n,) for n in ("i", "fence", "goats", "ann", "bob")], "phrase string")
    spans = phrases.phrase_spans(parts, names, phrases.tokens).select("key", F.col("phrase").alias("name"), F.lit("T").alias("kind"), "at", "n")
    edges = [(r.subject, r.rel_type, r.object) for r in lifts.lifted_edges(parts, spans).orderBy("position").collect()]
    assert edges == [("i", "fix", "fence"), ("fence", "where", "goats"), ("goats", "graze", "ann"), ("ann", "visit", "bob")]


def test_at_most_twelve_edges_a_sentence(spark):
    text = " ".join(f"n{i} saw" for i in range(20)) + " n20"
    parts = spark.createDataFrame([(1, text)], "key int, text string").select("key", "text", phrases.tokens(F.col("text")).alias("tokens"))
    spans = phrases.phrase_spans(parts, spark.createDataFrame([(f"n{i}",) for i in range(21)], "phrase string"), phrases.tokens)
    spans = spans.select("key", F.col("phrase").alias("name"), F.lit("T").alias("kind"), "at", "n")
    assert [r.subject for r in lifts.lifted_edges(parts, spans).orderBy("position").collect()] == [f"n{i}" for i in range(12)]
    assert lifts.lifted_edges(parts, spans, most=None).count() == 20


POSSESSIVES = {
    "my car's gps system failed today": {"car": "gps system", "my car": "gps system"},
    "the car's gps's antenna failed": {"car": "antenna", "gps": "antenna"},
    "my car's gps system's antenna": {"car": "antenna", "system": "antenna", "gps system": "antenna"},
    "the workers' union hall": {"workers": "union hall"},
    "the car’s the old engine in the shop": {"car": "old engine"},
    "my car's wiring is bad": {"car": "wiring"},
    "the car's in the shop": {},
    "a car's": {},
    "the car's, well, engine": {},
    "ann's big old rusty blue wagon": {"ann": "big old rusty blue"},
    "ann's big red wagon": {"ann": "big"},  # looks like a verb form
    "'s": {},
    "no owner here": {},
}


@pytest.mark.parametrize("text", POSSESSIVES)
def test_possessive_heads(text):
    found = {}
    for _, owner, head in lifts.possessives(text):
        found.setdefault(owner, head)
    assert {k: v for k, v in found.items() if k in POSSESSIVES[text]} == POSSESSIVES[text] and bool(found) == bool(POSSESSIVES[text])


def test_objects_move_to_what_they_have(spark):
    texts = spark.createDataFrame([(1, "I had an issue with my car's GPS system."), (2, "He owns a car."), (3, None)], "key int, text string")
    edges = [(1, "user", "has_issue", "Car", "OBJECT"), (1, "user", "has_issue", "issue", "X"), (2, "he", "own", "car", "OBJECT"), (3, "a", "b", None, "C")]
    got = lifts.object_heads(spark.createDataFrame(edges, "key int, subject string, rel_type string, object string, object_type string"), texts)
    assert sorted(((r.key, r.object, r.object_type) for r in got.collect()), key=str) == sorted([(1, "gps system", None), (1, "issue", "X"), (2, "car", "OBJECT"), (3, None, "C")], key=str)


# --- phrases ---


def brute_spans(texts, listed):
    import re

    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    rows = set()
    for key, text in texts:
        ws = split(text or "")
        for phrase in listed:
            ps = split(phrase)
            rows |= {(key, phrase, i, len(ps)) for i in range(len(ws) - len(ps) + 1) if ps and ws[i : i + len(ps)] == ps}
    return rows


def test_phrases_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "new", "york", "é"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(30)] + [(99, None), (98, "")]
    listed = ["new york", "a", "a b", "a b c new", "É", "york-new", "", "!!", "zz top"]
    frame = spark.createDataFrame(texts, "key int, text string")
    found = phrases.phrase_spans(frame, spark.createDataFrame([(p,) for p in listed] + [(None,), ("a",)], "phrase string"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == brute_spans(texts, listed) and len(rows) == len(set(rows))
    merged = defaultdict(list)
    for key, _, at, n in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        if merged[key] and at <= merged[key][-1][1]:
            merged[key][-1] = (merged[key][-1][0], max(merged[key][-1][1], at + n))
        else:
            merged[key].append((at, at + n))
    assert {(r.key, r["at"], r["at"] + r.n) for r in phrases.merged_spans(found).collect()} == {(k, *s) for k, spans in merged.items() for s in spans}


def test_no_nested_loop_in_the_plan(spark):
    texts = spark.createDataFrame([(1, "a b c")], "key int, text string")
    listed = spark.range(1000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" b")).alias("phrase"), F.lit(1).alias("priority"), F.lit("t").alias("target"))
    plan = phrases.longest_phrase(texts, listed)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_longest_phrase(spark):
    texts = spark.createDataFrame([(1, "Please forget about my dog"), (2, "forget me not"), (3, "nothing")], "key int, text string")
    listed = spark.createDataFrame([("forget", 1, "a"), ("forget about", 1, "b"), ("dog", 2, "c"), ("get", 9, "never inside a word")], "phrase string, priority int, target string")
    assert {(r.key, r.phrase, r.target) for r in phrases.longest_phrase(texts, listed).collect()} == {(1, "dog", "c"), (2, "forget", "a")}


def test_longest_phrase_keeps_a_number_a_text(spark):
    texts = spark.range(5).select(F.col("id").alias("key"), F.lit("forget the dog").alias("text"))
    listed = spark.createDataFrame([("forget", None, "a"), ("dog", 1, "b"), ("dog", 3, "c"), ("the", 3, "d")], "phrase string, priority int, target string")
    found = phrases.longest_phrase(texts, listed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning(head" not in plan
    assert {(r.phrase, r.target) for r in found.collect()} == {("the", "d")} and found.count() == 5


def test_a_relation_is_stated_once_and_numbered_without_gaps(spark):
    sentences = spark.createDataFrame([(1, "ann the bob met carl likes dora".split())], "key int, tokens array<string>")
    mentions_ = spark.createDataFrame([(1, n, "P", at, 1) for n, at in (("ann", 0), ("bob", 2), ("carl", 4), ("dora", 6))], "key int, name string, kind string, at int, n int")
    edges = lifts.lifted_edges(sentences, mentions_)
    assert [(r.position, r.subject, r.rel_type, r.object) for r in edges.orderBy("position").collect()] == [(1, "bob", "meet", "carl"), (2, "carl", "like", "dora")]
    assert [r.subject for r in lifts.lifted_edges(sentences, mentions_, most=1).collect()] == ["bob"]
    plan = lifts.lifted_edges(sentences, mentions_)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("slice(tokens") == 1  # the words between are cut out once, not in every step that reads them


def test_clauses(spark):
    texts = spark.createDataFrame([(1, " I moved. It rained!  i MOVED. I used to sing? "), (2, "no end"), (3, "  "), (4, None)], "key int, text string")
    found = phrases.clauses(texts, spark.createDataFrame([("used to",), ("moved",)], "phrase string"))
    assert sorted((r.key, r.position, r.clause, r.triggered) for r in found.collect()) == [(1, 0, "I moved.", True), (1, 1, "It rained!", False), (1, 3, "I used to sing?", True), (2, 0, "no end", False)]


def test_decomposers(spark):
    texts = spark.createDataFrame([(1, "One. Two! one."), (2, None)], "key int, text string")
    rows = lambda name: sorted((r.key, r.position, r.clause) for r in decomposers.decompose(texts, name).collect())
    assert rows(None) == rows("SENTENCE ") == rows("unknown") == [(1, 0, "One."), (1, 1, "Two!")]
    assert rows("chunk") == [(1, 0, "One. Two! one.")]
    decomposers.register(" Whole ", lambda t: t.where("text is not null").selectExpr("key", "cast(0 as bigint) as position", "text as clause"))
    assert rows("whole") == [(1, 0, "One. Two! one.")]
    with pytest.raises(ValueError):
        decomposers.register(" ", lambda t: t)


# --- pronouns ---


def test_ring_keeps_the_first_place_of_a_name():
    state = json.loads(mentions.EMPTY)
    for i in range(12):
        state = mentions.after_turn(state, [("likes", f"n{i}"), ("likes", "n0")])
    # n0 stands first until n10 pushes it out; named again a turn later it comes in anew, last
    assert state["ring"] == ["n3", "n4", "n5", "n6", "n7", "n8", "n9", "n10", "n11", "n0"] and state["stands"]["it"] == "n0"


def test_pronouns_by_hand():
    state = mentions.after_turn(json.loads(mentions.EMPTY), [("spouse", "Ann"), ("has_pet", "Rex")])
    assert mentions.resolved(state, "Is she home?") == ["Ann"] and mentions.resolved(state, "feed it") == ["Rex"]
    assert mentions.resolved(state, "who are they") == ["Ann", "Rex"]  # the letters of he stand in they
    state = mentions.after_turn(state, [("child_of", "Tom")] + [("likes", f"x{i}") for i in range(10)])
    assert "she" not in state["stands"] and "they" not in state["stands"] and state["stands"]["it"] == "x9"
    assert mentions.resolved(state, "they") == ["x9"] and mentions.resolved(state, "none") == []


@pytest.mark.parametrize("part", [1, 3, 7, 1000])
def test_parts_of_a_conversation_agree(spark, part):
    rng = random.Random(part)
    turns, named, expected = [], [], set()
    for conv in range(6):
        state = json.loads(mentions.EMPTY)
        for turn in sorted(rng.sample(range(60), rng.choice([1, 5, 40]))):
            text = rng.choice(["she", "it is", "they", "nothing", None])
            said = [(rng.choice(["spouse", "likes", "child_of", "has_pet"]), f"n{rng.randint(0, 14)}") for _ in range(rng.randint(0, 3))]
            turns.append((conv, turn, text))
            named += [(conv, turn, i, r, n) for i, (r, n) in enumerate(said)]
            expected |= {(conv, turn, tuple(names)) for names in [mentions.resolved(state, text)] if names}
            state = mentions.after_turn(state, said)
    rows = mentions.pronoun_names(spark.createDataFrame(turns, "conv_id long, turn long, text string"), spark.createDataFrame(named, "conv_id long, turn long, place int, relation string, name string"), part=part)
    assert {(r.conv_id, r.turn, tuple(r.names)) for r in rows.collect()} == expected


# --- replies ---

BODY = {"choices": [{"message": {"content": 'a "quoted" } { \\ brace\n'}}], "id": 1}


@pytest.mark.parametrize(
    "text, how",
    [
        (json.dumps(BODY), "whole"), ('{"ping": 1}\n' + json.dumps(BODY), "line"), ("data: " + json.dumps(BODY) + " }", "scan"), ('{"outer": ' + json.dumps(BODY), "scan"), ('{"a": "{" ' + json.dumps(BODY), "scan"),
        ('said "here {' + json.dumps(BODY), "scan"), (json.dumps({"x": "choices"}), None), (json.dumps(BODY)[:-3], None), ("", None), (None, None), ('{"choices"', None), ('["choices"]', None), ("{" * 3000 + '"choices": 1', None),
        (json.dumps({"data": {"choices": 1}, "n": 2}), "scan"),
    ],
)
def test_replies(text, how):
    found = replies.reply(text)
    assert found[0] == how
    if how and "data\":" not in text[:9]:
        assert json.loads(found[1]) == BODY


def test_replies_between_damaged_parts():
    rng = random.Random(1)
    whole = json.dumps(BODY)
    for _ in range(300):
        head, tail = whole[: rng.randint(0, len(whole) - 1)], whole[rng.randint(1, len(whole)) :]
        strategy, found = replies.reply(head + "\x00" + whole + tail)
        assert strategy and json.loads(found) == BODY
