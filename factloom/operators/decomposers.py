"""How texts become clauses: strategies by name, of which the sentence is the one that is always there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from factloom.operators import phrases, texts

Decomposer = Callable[[DataFrame], DataFrame]


def _sentences(rows: DataFrame) -> DataFrame:
    return phrases.clauses(rows, rows.sparkSession.createDataFrame([], "phrase string")).select("key", "position", "clause")


def _chunks(rows: DataFrame) -> DataFrame:
    return texts.chunks(rows.selectExpr("key as doc_id", "text")).selectExpr("doc_id as key", "cast(position as bigint) as position", "chunk as clause")


STRATEGIES: dict[str, Decomposer] = {"sentence": _sentences, "chunk": _chunks}


def register(name: str, strategy: Decomposer) -> None:
    """Keep a strategy under a name, in any case; it takes (key, text) and gives (key, position, clause)."""
    if not name.strip() or not callable(strategy):
        raise ValueError("a strategy needs a name and a function")
    STRATEGIES[name.strip().lower()] = strategy


def decompose(rows: DataFrame, strategy: str | None = None) -> DataFrame:
    """(key, position, clause) of texts (key, text) by a strategy; an unknown one is that of sentences."""
    return STRATEGIES.get((strategy or "sentence").strip().lower(), _sentences)(rows)
