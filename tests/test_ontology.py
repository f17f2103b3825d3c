"""Identities, overlays, eligible groups, fingerprints, similar vectors and questions, against values written by hand and plain Python."""

import datetime as dt
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import gate, graphs, identity, overlay, placement, questions, similar
from factloom.sources import driver_tables

SPACE = uuid.UUID(identity.NAMESPACE)
USER = "11111111-2222-3333-4444-555555555555"


def minted(user, name):
    return str(uuid.uuid5(SPACE, f"{user.lower()}:{name}"))


# --- identity ---


def test_names_resolve_in_order(spark):
    names = [(USER, n) for n in ("Me", " USER ", "Rex", "both", "parent_of", "new one", "", "x" * 300, "0a0a0a0a-0000-0000-0000-000000000001")] + [("bob", "I"), ("bob", "Rex")]
    one, two = "0a0a0a0a-0000-0000-0000-000000000002", "0a0a0a0a-0000-0000-0000-000000000003"
    aliases = [(USER, "rex", one, False), (USER, "REX", two, True), (USER, "both", two, True), (USER, "both", USER, False), (USER, "new one", "not-an-id", True), ("bob", "other", one, True)]
    entities = [(USER, "0a0a0a0a-0000-0000-0000-000000000001"), (USER, "new one")]
    found = identity.resolved(
        spark.createDataFrame(names, "user_id string, name string"), spark.createDataFrame(aliases, "user_id string, alias string, entity_id string, preferred boolean"),
        spark.createDataFrame(entities, "user_id string, entity_id string"), spark.createDataFrame([("Parent_Of",)], "rel_type string"),
    )
    got = {(r.user_id, r.name): (r.entity_id, r.rung) for r in found.collect()}
    assert got == {
        (USER, "me"): (USER, "self"), (USER, "user"): (USER, "self"), (USER, "rex"): (two, "alias"), (USER, "both"): (USER, "alias"), (USER, "parent_of"): (None, "relation"),
        (USER, "new one"): (minted(USER, "new one"), "minted"), (USER, "x" * 256): (minted(USER, "x" * 256), "minted"), (USER, "0a0a0a0a-0000-0000-0000-000000000001"): ("0a0a0a0a-0000-0000-0000-000000000001", "entity"),
        ("bob", "i"): (minted("bob", "bob"), "self"), ("bob", "rex"): (minted("bob", "rex"), "minted"),
    }
    entities, aliases = identity.minted(found)
    assert {r.entity_id for r in entities.collect()} == {r.entity_id for r in aliases.collect()} == {v[0] for v in got.values() if v[1] == "minted"}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(f"{a:03d}", f"{b:03d}") for a, b in ((rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45))] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [(None, "a")]
    root = {x: x for link in links if None not in link for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.id: r.least for r in identity.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}


def test_tables_are_rewritten_together_and_once(spark):
    facts = [(USER, "user", "owns", "Rex", 0.9), (USER, "rex", "instance_of", "Dog", 0.5), (USER, "my dog", "instance_of", "dog", 0.8), (USER, "my dog", "same_as", "rex", 1.0), (USER, USER, "lives_in", "x", 0.1), ("bob", "rex", "is", "cat", 1.0)]
    tables = {
        "facts": spark.createDataFrame(facts, "user_id string, subject_id string, rel_type string, object_id string, confidence double"),
        "aliases": spark.createDataFrame([(USER, "REX", "rex", False), (USER, "rex", "my dog", True)], "user_id string, alias string, entity_id string, preferred boolean").withColumn("alias", F.lower("alias")),
        "attributes": spark.createDataFrame([(USER, "rex", "age", "4", 1), (USER, "my dog", "age", "5", 2)], "user_id string, entity_id string, attribute string, value string, updated_at int"),
        "entities": spark.createDataFrame([(USER, "rex", "Animal"), (USER, "my dog", "unknown")], "user_id string, entity_id string, entity_type string"),
    }
    links = spark.createDataFrame([(USER, "my dog", "rex")], "user_id string, a string, b string")
    new = identity.rewritten(tables, links)
    dog = min(minted(USER, "rex"), minted(USER, "my dog"))
    kind = minted(USER, "dog")
    rows = {(r.user_id, r.subject_id, r.rel_type, r.object_id, r.confidence) for r in new["facts"].collect()}
    assert rows == {(USER, USER, "owns", dog, 0.9), (USER, dog, "instance_of", kind, 0.8), (USER, USER, "lives_in", minted(USER, "x"), 0.1), ("bob", minted("bob", "rex"), "is", minted("bob", "cat"), 1.0)}
    assert [(r.entity_id, r.value) for r in new["attributes"].collect()] == [(dog, "5")]
    entities = {(r.user_id, r.entity_id): r.entity_type for r in new["entities"].collect()}
    assert entities[USER, dog] == "Animal" and {(u, i) for u, s, _, o, _ in rows for i in (s, o)} <= set(entities)
    named = {(r.user_id, r.entity_id) for r in new["aliases"].collect()}
    assert (USER, dog) in named and ("bob", minted("bob", "cat")) in named
    again = identity.rewritten(new, links)
    assert all(Counter(map(tuple, again[t].collect())) == Counter(map(tuple, new[t].collect())) for t in ("facts", "aliases", "attributes"))


# --- overlays ---


def test_first_rung_never_mixes(spark):
    t = "tenant_id string, rel_type string, label string"
    own, registry = spark.createDataFrame([("a", "x", "own")], t), spark.createDataFrame([("a", "y", "reg"), ("b", "x", "reg"), ("b", "y", "reg")], t)
    seed = spark.createDataFrame([("x", "seed"), ("z", "seed")], "rel_type string, label string")
    tenants = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "tenant_id string")
    got = {(r.tenant_id, r.rung, r.rel_type, r.label) for r in overlay.first_rung(tenants, own, registry, seed).collect()}
    assert got == {("a", "overlay", "x", "own"), ("b", "registry", "x", "reg"), ("b", "registry", "y", "reg"), ("c", "seed", "x", "seed"), ("c", "seed", "z", "seed"), (None, "seed", "x", "seed"), (None, "seed", "z", "seed")}


def test_seed_never_touches_corrections(spark):
    tenant = spark.createDataFrame([("a", "x", "mine", "k1", "user_corrected"), ("a", "y", "old", "k2", "seeded"), ("b", "y", "old", None, None)], "tenant_id string, rel_type string, label string, kept string, source string")
    seed = spark.createDataFrame([("x", "new", "seeded"), ("y", "new", "seeded"), ("z", "new", "seeded")], "rel_type string, label string, source string")
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    first = overlay.seeded(tenant, seed, tenants, ["rel_type"], ["label"])
    want = {("a", "x", "mine", "k1", "user_corrected"), ("a", "y", "new", "k2", "seeded"), ("b", "y", "new", None, None), ("b", "x", "new", None, "seeded")} | {(t, "z", "new", None, "seeded") for t in "ab"}
    assert {tuple(r) for r in first.collect()} == want and first.count() == len(want)
    assert {tuple(r) for r in overlay.seeded(first, seed, tenants, ["rel_type"], ["label"]).collect()} == want


def test_seed_copies_of_aliases_cues_and_nesting(spark):
    aliases = spark.createDataFrame([("a", "mom", "grown")], "tenant_id string, alias string, canonical string")
    seed = spark.createDataFrame([("mom", "parent_of"), ("boss", "works_for"), ("ghost", "unknown_rel")], "alias string, canonical string")
    relations = spark.createDataFrame([("a", "parent_of"), ("a", "works_for"), ("b", "parent_of")], "tenant_id string, rel_type string")
    assert {tuple(r) for r in overlay.seeded_aliases(aliases, seed, relations).collect()} == {("a", "mom", "grown"), ("a", "boss", "works_for"), ("b", "mom", "parent_of")}
    cues = spark.createDataFrame([("a", "call", "naming_verb", "own")], "tenant_id string, cue string, category string, source string")
    offered = spark.createDataFrame([("call", "naming_verb", "seed"), ("name", "naming_verb", "seed"), ("nurse", "social_role", "seed")], "cue string, category string, source string")
    assert {tuple(r) for r in overlay.seeded_cues(cues, offered, spark.createDataFrame([("a",)], "tenant_id string")).collect()} == {("a", "call", "naming_verb", "own"), ("a", "name", "naming_verb", "seed")}
    rows = [("family", None, [], False), ("family", "user_corrected", [], False), ("family", "seeded", ["x"], False), ("work", "seeded", [], False)]
    got = overlay.nested(spark.createDataFrame(rows, "taxonomy_name string, source string, member_taxonomies array<string>, is_hierarchical boolean")).collect()
    assert [(r.member_taxonomies, r.is_hierarchical) for r in got] == [(["pets"], True), ([], False), (["x"], False), ([], False)]
    old = overlay.with_source(spark.createDataFrame([("family",)], "taxonomy_name string")).first()
    assert old.source == "seeded"


def test_recorded_aliases(spark):
    aliases = spark.createDataFrame([("a", "has_issue", "seen", False, "ontology")], "tenant_id string, alias string, canonical string, requires_inversion boolean, source string")
    claims = [("a", "had an issue with", "x", False, "engine"), ("a", "is employed by", " Works_For ", True, "engine"), ("a", "works for", "work_for", False, "engine"), ("a", "sings", "sings_at", False, "stranger"), ("a", "the", "", False, "engine"), ("a", "lives near", "b", False, "user_corrected"), ("a", "lived near", "a", False, "engine")]
    got = {tuple(r) for r in overlay.recorded_aliases(aliases, spark.createDataFrame(claims, aliases.schema)).collect()}
    assert got == {("a", "has_issue", "seen", False, "ontology"), ("a", "employ_by", "works_for", True, "engine"), ("a", "live_near", "a", False, "engine")}


def test_current_rows_of_a_log(spark):
    log = [("x", 1, "seeded", "a"), ("x", 2, "user_corrected", "b"), ("x", 3, "seeded", "c"), ("x", 4, "user_corrected", "d"), ("x", 5, "seeded", "e"), ("y", 1, "seeded", "a"), ("y", 2, None, "b")]
    got = {(r.k, r.v) for r in overlay.current(spark.createDataFrame(log, "k string, at int, source string, v string"), ["k"]).collect()}
    assert got == {("x", "d"), ("y", "b")}


def test_eligible_groups_by_hand(spark):
    relations = [("instance_of", True, "P31", ["ANY"], ["ANY"]), ("member_of", True, None, ["Person"], ["Person"]), ("owns", False, None, ["Person"], ["Object"]), ("age", False, None, ["person"], ["SCALAR"]), ("knows", None, None, None, None)]
    meta = spark.createDataFrame(relations, "rel_type string, is_hierarchy_rel boolean, wikidata_pid string, head_types array<string>, tail_types array<string>")
    rels = ["Owns", "knows", "instance_of", "age", "novel", "member_of"]
    groups = [("family", ["Person"], rels), ("any", ["ANY"], rels), ("empty", [], rels), ("null", None, rels), ("none", ["Person"], None), ("bare", ["Person"], [])]
    table = spark.createDataFrame(groups, "taxonomy_name string, members array<string>, defining_rels array<string>")
    want = {"family": ["knows", "age", "novel", "member_of"], "any": ["Owns", "knows", "age", "novel", "member_of"], "empty": rels, "null": rels, "none": None, "bare": []}
    assert {r.taxonomy_name: r.defining_rels for r in overlay.eligible_groups(table, meta).collect()} == want
    changed = spark.createDataFrame([("OWNS",)], "rel_type string")
    assert {r.taxonomy_name: r.defining_rels for r in overlay.eligible_groups(table, meta, changed).collect()} == want
    other = spark.createDataFrame([("nothing",)], "rel_type string")
    assert {r.taxonomy_name: r.defining_rels for r in overlay.eligible_groups(table, meta, other).collect()} == {g[0]: g[2] for g in groups}


def test_category_advice(spark):
    groups = spark.createDataFrame([("family", ["Person"], ["spouse"])], "taxonomy_name string, members array<string>, defining_rels array<string>")
    edges = [("Spouse", "family", "person", "Dog"), ("likes", "family", "Dog", "Dog"), ("spouse", "work", "Dog", None), ("spouse", None, None, None), ("spouse", "family", "unknown", None)]
    got = overlay.category_advice(spark.createDataFrame(edges, "rel_type string, category string, subject_type string, object_type string"), groups).collect()
    assert sorted((r.advice, r.subject_outside, r.object_outside) for r in got) == [("checked", False, False), ("checked", False, True), ("no_category", False, False), ("other_relation", False, False), ("unknown_category", False, False)]


@pytest.mark.parametrize("seed", range(3))
def test_fingerprints_do_not_depend_on_how_the_log_is_split(spark, seed):
    rng = random.Random(seed)
    log = [(rng.choice("abc"), rng.choice(["in", "of"]), f"o{rng.randint(0, 4)}", True) for _ in range(40)]
    gone = [(*e[:3], False) for e in rng.sample(log, 15)]
    schema = "entity_id string, rel_type string, object string, live boolean"
    whole = placement.fingerprints(placement.edge_sums(spark.createDataFrame(log + gone, schema))).collect()
    left = Counter(e[:3] for e in log) - Counter(e[:3] for e in gone)
    kept = placement.fingerprints(placement.edge_sums(spark.createDataFrame([(*e, True) for e in left.elements()], schema))).collect()
    mixed = log + gone
    rng.shuffle(mixed)
    cut = rng.randint(1, len(mixed) - 1)
    parts = placement.fingerprints(placement.added(*[placement.edge_sums(spark.createDataFrame(p, schema)) for p in (mixed[:cut], mixed[cut:])])).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in kept} == {tuple(r) for r in parts}
    again = placement.to_place(spark.createDataFrame(whole), spark.createDataFrame([(r.entity_id, "placed", 1, r.fingerprint if r.entity_id != "a" else "old") for r in whole], "entity_id string, verdict string, attempts int, fingerprint string"))
    assert [r.entity_id for r in again.collect()] == ["a"]


# --- walks to the end ---


def test_descent_has_no_depth_and_ends_on_cycles(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(7)] + [("n0", "n7"), ("side", "n3"), ("side", "n5")]
    edges = spark.createDataFrame(chain, "subject string, object string")
    roots = spark.createDataFrame([("n0",), ("n6",)], "entity_id string")
    got = {(r.root, r.node): r.depth for r in graphs.walk_down(edges, roots).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "n0"} == {**{f"n{i}": i for i in range(8)}, "side": 4}
    assert got["n6", "n5"] == 7 and got["n6", "side"] == 6
    families = spark.createDataFrame([(o, s) for s, o in chain[:7]], "family string, member string")
    below = {(r.root, r.member): r.depth for r in graphs.nested_members(families, spark.createDataFrame([("n5", "n6")], "family string, member string")).collect()}
    assert below["n0", "n5"] == 5 and ("n0", "n6") not in below and below["n6", "n7"] == 1


# --- similar vectors ---


@pytest.mark.parametrize("threshold, pivots, block", [(0.9, 8, 5), (0.5, 3, 4096), (-0.2, 16, 7)])
def test_similar_vectors_against_brute_force(spark, threshold, pivots, block):
    rng = np.random.default_rng(int(pivots))
    centres = rng.normal(size=(4, 6))
    vectors = np.concatenate([centres[rng.integers(0, 4, 80)] + 0.3 * rng.normal(size=(80, 6)), np.repeat(centres[:1], 30, axis=0)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0]), (903, [float("nan")] * 6), (904, [None] * 6)]
    frame = spark.createDataFrame(rows + odd, "id long, v array<double>")
    asked = frame.where("id % 5 = 0 or id >= 900")
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = units @ units.T
    want = {(i, j) for i in range(0, len(rows), 5) for j in range(len(rows)) if i != j and scores[i, j] >= threshold}
    found = similar.similar(asked, frame, threshold, pivots=pivots, block=block).collect()
    assert {(r.query, r.id) for r in found} == want and len(found) == len(want)
    best = similar.similar(asked, frame, threshold, most=2, pivots=pivots, block=block).collect()
    assert all(abs(r.similarity - scores[r.query, r.id]) < 1e-9 for r in best)
    for i in {a for a, _ in want}:
        top = sorted((-round(scores[i, j], 9), j) for a, j in want if a == i)[:2]
        assert sorted(-round(r.similarity, 9) for r in best if r.query == i) == [t[0] for t in top]


def test_queries_of_a_cell_are_dealt_in_blocks(spark):
    vectors = spark.range(40).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    found = similar.similar(vectors, vectors, 0.9, pivots=4, block=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "share" in plan  # a task holds a block of queries and a block of vectors
    assert found.count() == 40 * 39
    assert similar._grouped(np.array([3, 0, 4, 9, 1, 1]), 8).tolist() == [0, 0, 0, 1, 2, 2]


# --- questions ---

NOW = dt.date(2024, 6, 1)


def planned(spark, *texts):
    rows = spark.createDataFrame([(i, "u", t, NOW) for i, t in enumerate(texts)], "id int, user_id string, text string, now date")
    return [r for r in questions.planned(rows).orderBy("id").collect()]


def test_orders_and_bounds(spark):
    asked = ["what was my first issue after my service", "what is coming up", "what is the most recent event", "who is my spouse", "where did I used to live", "what was my previously held job", "what pets do I no longer have", "did I ever mention a dog", "where do I live", "what did I do last week", None]
    got = [(r.order, r.bound, r.status, r.history) for r in planned(spark, *asked)]
    assert got == [("asc", "after", None, False), (None, None, "future", False), ("desc", None, None, False), (None, None, None, False), (None, None, None, True), (None, None, None, True), (None, None, None, True), (None, None, None, True), (None, None, None, False), (None, None, None, False), (None, None, None, False)]


def test_months(spark):
    asked = ["[Date: 2023/03/10]\nWhich vehicle did I take care of first in February, the bike or the car?", "Which did I wash first in February?", "[Date: 2023/03/10]\nWhat did I do in February 2021?", "in may I ask"]
    got = [(str(r.month.start), str(r.month.end)) for r in planned(spark, *asked)]
    assert got == [("2023-02-01", "2023-03-01"), ("2024-02-01", "2024-03-01"), ("2021-02-01", "2021-03-01"), ("2024-05-01", "2024-06-01")]


CALCULATIONS = {
    "how many days did it take to find a house after starting to work with rachel?": ("between", "did it take to find a house", "starting to work with rachel", "days", None),
    "how long before i moved did i start the job?": ("between", "i start the job", "i moved", "days", None),
    "did i move after i started the job?": ("allen", "i move", "i started the job", None, "after"),
    "was the house before rachel?": ("allen", "the house", "rachel", None, "before"),
    "How many weeks between the move and the wedding?": ("between", "the move", "the wedding", "weeks", None),
    "how long ago did I graduate": ("ago", "did i graduate", None, "days", None),
    "Was the trip in the same week as the party?": ("same", "the trip", "the party", "week", None),
    "who is my spouse": None,
    "how many dogs do I have": None,
    "": None,
}


def test_calculations(spark):
    got = [r.calc for r in planned(spark, *CALCULATIONS)]
    assert [c and (c.op, c.anchor, c.anchor_b, c.unit, c.relation) for c in got] == list(CALCULATIONS.values())


def test_answers_cite_their_dates(spark):
    facts = [("u", 1, "found", "house", dt.date(2023, 3, 1)), ("u", 2, "work_with", "rachel", dt.date(2023, 2, 15)), ("u", 3, "visited", "house", None), ("v", 4, "found", "house", dt.date(1999, 1, 1)), ("u", 5, "graduated", "school", dt.date(2024, 5, 1))]
    table = spark.createDataFrame(facts, "user_id string, fact_id long, rel_type string, object string, event_date date")
    asked = ["how many days did it take to find a house after starting to work with rachel?", "did i find the house before working with rachel?", "did I work with rachel in the same month as I found the house?", "how many weeks ago did I graduate?", "how long after the wedding did I find a house?", "how many months between the house and graduating?"]
    rows = spark.createDataFrame([(i, "u", t, NOW) for i, t in enumerate(asked)], "id int, user_id string, text string, now date")
    got = {r.id: (r.op, r.value, r.unit, r.answer, [str(d) for d in r.cited_dates], r.miss) for r in questions.computed(questions.planned(rows), table).collect()}
    both = ["2023-02-15", "2023-03-01"]
    assert got == {
        0: ("between", 14, "days", None, both, False), 1: ("allen", None, None, "no", both, False), 2: ("same", None, None, "no", both, False), 3: ("ago", 4, "weeks", None, ["2024-05-01"], False),
        4: ("between", None, "days", "no date for: the wedding", ["2023-03-01"], True), 5: ("between", -14, "months", None, ["2023-03-01", "2024-05-01"], False),
    }


def test_an_anchor_of_a_user_meets_the_facts_once(spark):
    day = lambda n: dt.date(2024, 1, n)
    facts = [("u", 1, "found", "house", day(9)), ("u", 2, "saw", "house", day(3)), ("u", 3, "saw", "house", day(3)), ("v", 4, "found", "house", day(1)), ("w", 5, "found", "house", None)]
    table = spark.createDataFrame(facts, "user_id string, fact_id long, rel_type string, object string, event_date date")
    anchors = spark.createDataFrame([("u", "house")] * 50 + [("u", "found house"), ("u", "car"), ("w", "house"), (None, "house")], "user_id string, words string")
    got = sorted(map(tuple, questions.matched(anchors, table).collect()))
    assert got == [("u", "found house", 1, day(9)), ("u", "house", 2, day(3))]
    words = [tuple(r.words) for r in planned(spark, "did i find the houses before i moved?", "how long ago did i find it", "who am i")]
    assert words == [("find house", "move"), ("find", None), (None, None)]


def test_walks(spark):
    facts = [("u", 1, dt.date(2024, 1, 5), False), ("u", 2, dt.date(2024, 7, 1), False), ("u", 3, None, False), ("u", 4, dt.date(2024, 1, 2), True), ("v", 5, dt.date(2020, 1, 1), False)]
    table = spark.createDataFrame(facts, "user_id string, fact_id long, event_date date, superseded boolean")
    asked = ["what was my first job", "my latest job", "what is coming up", "what did I used to do", "what did I do in January", "who am I"]
    rows = spark.createDataFrame([(i, "u", t, NOW) for i, t in enumerate(asked)], "id int, user_id string, text string, now date")
    got = {}
    for r in questions.walked(questions.planned(rows), table).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.fact_id)
    assert got == {0: [1], 1: [2], 2: [2, 3], 3: [4, 1, 2, 3], 4: [1], 5: [1, 2, 3]}


def test_what_is_mine(spark):
    facts = spark.createDataFrame([("u", "spouse", "id1"), ("u", "has_pet", "rex"), ("u", "likes", "green tea"), ("w", "spouse", "id2")], "user_id string, rel_type string, object string")
    names = spark.createDataFrame([("id1", "Ann"), ("id2", "Eve")], "object string, display string")
    asked = spark.createDataFrame([(1, "u", "Where is my wife?"), (2, "u", "my tea!"), (3, "u", "our dog"), (4, "w", "my husband"), (5, "u", "me")], "id int, user_id string, text string")
    got = {(r.id, r.entity) for r in questions.own_entities(asked, facts, names).collect()}
    assert got == {(1, "ann"), (2, "green tea"), (3, "rex"), (4, "eve")}


# --- the gate ---


def test_no_task_of_the_gate_has_all_edges_of_a_relation(spark):
    edges = spark.createDataFrame([("a", "supplies", "b"), ("a", "supplies", "c"), ("a", None, "b"), ("d", "novel", None), ("e", "supplies", "b")], "subject string, rel_type string, object string")
    types = spark.createDataFrame([("a", "unknown"), ("b", "Object"), ("up", "Organization")], "entity_id string, entity_type string")
    above = spark.createDataFrame([("a", "in", "up")], "subject string, rel_type string, object string")
    rows = gate.typed(edges, types, driver_tables.rel_types(spark), above)
    assert "hashpartitioning(rel_type" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.subject, r.rel_type or "", r.object or "", r["head"], r.head_walked, r["tail"], r.reason) for r in rows.withColumn("reason", gate.type_reason()).collect())
    assert got == [
        ("a", "", "b", None, "Organization", "Object", "unconstrained"), ("a", "supplies", "b", None, "Organization", "Object", "valid"), ("a", "supplies", "c", None, "Organization", None, "type_unknown"),
        ("d", "novel", "", None, None, None, "unconstrained"), ("e", "supplies", "b", None, None, "Object", "type_unknown"),
    ]
    marked = edges.withColumns({"confidence": F.lit(0.92), "provenance": F.lit("llm_inferred"), "is_correction": F.lit(False)})
    found = gate.gate(marked, types, driver_tables.rel_types(spark), above).collect()
    assert sorted((r.subject, r.rel_type, r.object or "", r.status) for r in found) == [("a", "supplies", "b", "conflict"), ("a", "supplies", "c", "conflict"), ("d", "novel", "", "valid"), ("e", "supplies", "b", "valid")]
