"""Replays of small state machines over event logs.

Where what happens to an event depends on what became of those before it, no
window expresses the rule.  Events are dealt by key and sorted inside the
partition by Spark; a task then streams them in Arrow batches and holds the
state of one key at a time, so a key of any size needs the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from factloom.shipping import ship

State = dict


def replay(log: DataFrame, key: list[str], start: Callable[[], State], step: Callable[[State, dict], dict | None], out: str, end: Callable[[State], dict | None] = lambda state: None, given: list[str] | None = None) -> DataFrame:
    """Rows that ``step`` gives for each event, in (ts, id) order of its key, and ``end`` for each key; None gives no row.

    Rows are completed with the key's columns; ``out`` names all columns and types.  A step sees the columns ``given``
    (default: all) as a dict.
    """
    ship(log.sparkSession)
    schema: StructType = _parse_datatype_string(out)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, rows = None, {}, []

        def close() -> None:
            last = end(state) if held is not None else None
            if last is not None:
                rows.append(dict(zip(key, held)) | last)

        for batch in batches:
            names = batch.schema.names
            columns = [c.to_pylist() for c in batch.columns]
            for mine, values in zip(zip(*columns[: len(key)]), zip(*columns)):
                event = dict(zip(names, values))
                if mine != held:
                    close()
                    held, state = mine, start()
                made = step(state, event)
                if made is not None:
                    rows.append(dict(zip(key, mine)) | made)
            yield pa.RecordBatch.from_pylist([{name: r.get(name) for name in arrow.names} for r in rows], schema=arrow)
            rows.clear()
        close()
        yield pa.RecordBatch.from_pylist([{name: r.get(name) for name in arrow.names} for r in rows], schema=arrow)

    columns = [*key, *(c for c in given or log.columns if c not in key)]
    return log.repartition(*key).sortWithinPartitions(*key, "ts", "id").select(*columns).mapInArrow(run, schema)
