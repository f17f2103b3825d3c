"""Answers of models as JSON objects, also from damaged texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.shipping import ship

_COLON = re.compile(r"\s*:")
_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def _object(text: str, key: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and key in found else None


def holders(text: str, low: int, name: str) -> Iterator[str]:
    """Objects that hold the key (``name``, quoted) themselves, by their start, of the balanced text that begins at the brace at ``low``.

    A stack of open braces; strings, with their escapes, are passed over whole,
    and a string that is the key marks the innermost open object.
    """
    stack: list[list] = []
    pairs = []
    for mark in _MARK.finditer(text, low):
        said = mark.group()
        if said == "{":
            stack.append([mark.start(), False])
        elif said == "}":
            start, holds = stack.pop()
            if holds:
                pairs.append((start, mark.end()))
            if not stack:
                break
        elif said == name and _COLON.match(text, mark.end()):
            stack[-1][1] = True
    return (text[a:b] for a, b in sorted(pairs))


def scanned(text: str, key: str) -> dict | None:
    """The first object with the key that the walk finds from any brace; a damaged start costs a walk from the next brace."""
    name = json.dumps(key)
    last = text.rfind(name)
    low = text.find("{")
    while 0 <= low < last:
        for candidate in holders(text, low, name):
            found = _object(candidate, key)
            if found is not None:
                return found
        low = text.find("{", low + 1)
    return None


def reply(text: str | None, key: str = "choices") -> tuple[str | None, str | None]:
    """How an object with the key was found (whole, line or scan), and the object; nulls if there is none."""
    if not text:
        return None, None
    whole = _object(text, key)
    if whole is not None:
        return "whole", json.dumps(whole)
    for line in text.strip().split("\n"):
        found = _object(line, key)
        if found is not None:
            return "line", json.dumps(found)
    found = scanned(text, key)
    return (None, None) if found is None else ("scan", json.dumps(found))


def parsed_replies(texts: DataFrame, key: str = "choices") -> DataFrame:
    """(key, strategy, reply): of each text (key, text) the first object with the key, as JSON; nulls if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [reply(t, key) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s for s, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], ["key", "strategy", "reply"])

    ship(texts.sparkSession)
    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(run, f"key {kind}, strategy string, reply string")
