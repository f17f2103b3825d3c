"""Pronouns by what a conversation lately mentioned.

A conversation carries the ten names that it mentioned last, in the order of
their first mention, and for each pronoun the name that it stands for.  A long
conversation is cut into parts by turn.  Every part runs from a state that it
assumes, at first the empty one; a part whose assumed state is not what the part
before ended with runs again from that, until all agree.  No task holds more
than a part, and the driver sees only how many parts are left.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import staged
from factloom.shipping import ship

RING, PART = 10, 2048

#: Which pronouns a relation gives its names to; every name is what ``it`` stands for.
PRONOUNS = {"spouse": ("she", "he"), "sibling_of": ("they",), "child_of": ("they",), "parent_of": ("they",)}

EMPTY = json.dumps({"ring": [], "stands": {}}, sort_keys=True)


def after_turn(state: dict, mentioned: Iterable[tuple[str, str]]) -> dict:
    """The state after a turn that mentions (relation, name) in this order."""
    ring, stands = list(state["ring"]), dict(state["stands"])
    for relation, name in mentioned:
        if name not in ring:
            ring.append(name)
        for pronoun in (*PRONOUNS.get(relation, ()), "it"):
            stands[pronoun] = name
    ring = ring[-RING:]
    return {"ring": ring, "stands": {p: n for p, n in stands.items() if n in ring}}


def resolved(state: dict, text: str) -> list[str]:
    """Names that the pronouns of a text stand for, sorted.

    As in the surveyed system a pronoun counts wherever its letters stand, and
    ``they`` falls back on the newest name.
    """
    low, stands = (text or "").lower(), state["stands"]
    found = {stands[p] for p in ("she", "he", "it", "they") if p in low and p in stands}
    if "they" in low and "they" not in stands and state["ring"]:
        found.add(state["ring"][-1])
    return sorted(found)


def _turns(rows: pa.Table) -> list[tuple[int, list[tuple[str, str]], str | None]]:
    """(turn, mentions, text) by turn, from rows of turn, place, relation, name and text (of place -1)."""
    order = rows.sort_by([("turn", "ascending"), ("place", "ascending")])
    turns: list[tuple[int, list[tuple[str, str]], str | None]] = []
    for turn, place, relation, name, text in zip(*(order.column(c).to_pylist() for c in ("turn", "place", "relation", "name", "text"))):
        if place < 0:
            turns.append((turn, [], text))
        elif turns and turns[-1][0] == turn:
            turns[-1][1].append((relation, name))
        else:
            turns.append((turn, [(relation, name)], None))
    return turns


def _ended(rows: pa.Table, starts: pa.Table) -> pa.Table:
    if not len(rows):
        return pa.table({"conv_id": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "state": pa.array([], pa.string())})
    state = json.loads(starts.column("state")[0].as_py() if len(starts) else EMPTY)
    for _, mentioned, _ in _turns(rows):
        state = after_turn(state, mentioned)
    return pa.table({"conv_id": rows.column("conv_id")[:1], "part": rows.column("part")[:1], "state": [json.dumps(state, sort_keys=True)]})


def _answered(rows: pa.Table, starts: pa.Table) -> pa.Table:
    out: dict[str, list] = {"conv_id": [], "turn": [], "names": []}
    if len(rows):
        conv, state = rows.column("conv_id")[0].as_py(), json.loads(starts.column("state")[0].as_py() if len(starts) else EMPTY)
        for turn, mentioned, text in _turns(rows):
            names = resolved(state, text)
            if names:
                for key, value in zip(out, (conv, turn, names)):
                    out[key].append(value)
            state = after_turn(state, mentioned)
    return pa.table(out, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("names", pa.list_(pa.string()))]))


def pronoun_names(said: DataFrame, mentions: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, turn, names): for each turn of ``said`` (conv_id, turn, text) the names that its pronouns stand for, where there are any.

    ``mentions`` has conv_id, turn, place (from 0), relation and name.  A turn's own
    mentions count from the next turn on.
    """
    spark = said.sparkSession
    ship(spark)
    texts = said.select("conv_id", "turn", F.lit(-1).alias("place"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("name"), "text")
    named = mentions.where("name is not null").select("conv_id", "turn", F.col("place").cast("int").alias("place"), "relation", "name", F.lit(None).cast("string").alias("text"))
    keys = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    rows = texts.unionByName(named).select(*keys, F.expr(f"cast(turn as bigint) div {part}").alias("part"), "place", "relation", "name", "text")
    rows = staged(rows, "mention-rows")
    parts = staged(rows.select("conv_id", "part").distinct(), "mention-parts")
    along = Window.partitionBy("conv_id").orderBy("part")  # a row a part
    follows = parts.select("conv_id", F.lead("part").over(along).alias("part"), F.col("part").alias("earlier")).where("part is not null")
    follows = staged(follows, "mention-order")
    starts = parts.select("conv_id", "part", F.lit(EMPTY).alias("state"))
    again, ends = follows.select("conv_id", F.col("earlier").alias("part")), None
    while not again.isEmpty():
        some = rows.join(again, ["conv_id", "part"], "left_semi").groupBy("conv_id", "part")
        ran = staged(some.cogroup(starts.join(again, ["conv_id", "part"], "left_semi").groupBy("conv_id", "part")).applyInArrow(_ended, "conv_id long, part long, state string"), "mention-ends")
        ends = ran if ends is None else staged(ends.join(ran, ["conv_id", "part"], "left_anti").unionByName(ran), "mention-ends")
        handed = follows.join(ends.withColumnRenamed("part", "earlier"), ["conv_id", "earlier"]).select("conv_id", "part", "state")
        assumed = starts.withColumnRenamed("state", "assumed")
        changed = staged(handed.join(assumed, ["conv_id", "part"]).where("state <> assumed").select("conv_id", "part", "state"), "mention-changed")
        starts = staged(starts.join(changed, ["conv_id", "part"], "left_anti").unionByName(changed), "mention-starts")
        again = changed.select("conv_id", "part")
    return rows.groupBy("conv_id", "part").cogroup(starts.groupBy("conv_id", "part")).applyInArrow(_answered, "conv_id long, turn long, names array<string>")

