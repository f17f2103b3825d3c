"""Streaming forms of the log operators.

The batch folds of ``factloom.operators`` work on tables; these take streams of
assertions (id, subject, rel_type, object, ts, ...), bounded in state by
watermarks and timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators import lifecycle
from factloom.shipping import ship

LATE, DAY_MS = "1 hour", 86_400_000


def assertion_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a folder of assertion files; ts is made an instant, which watermarks need."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(stream: DataFrame, key: list[str], within: str = "5 minutes") -> DataFrame:
    """Rows whose key was not seen within the window before them."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)


def counts(stream: DataFrame, width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Rows and values per event-time window and relation; a window is given out once the watermark closes it."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "rel_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "rel_type", "n", "total")


def session_counts(stream: DataFrame, key: str, gap: str, late: str = LATE) -> DataFrame:
    """Rows per session of a key."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def hit_lifecycle(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Staged triples as they are promoted or dropped, by the steps of ``lifecycle.hits``.

    Sightings wait until the watermark has passed them and are then taken in the
    order of their time, so that what comes out does not depend on how the log
    falls into batches.  A triple that was promoted stays known as such; one that
    was dropped begins anew with its next sighting.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, expires, done, waiting = state.get if state.exists else (0, 0, False, [])
        waiting = sorted([*waiting, *(int(t.timestamp() * 1000) for frame in frames for t in frame["ts"])])
        reached, out = state.getCurrentWatermarkMs(), []

        def pass_by(day: int) -> None:
            nonlocal count, expires
            before = count
            count, expires = lifecycle.aged(count, expires, day)
            if before > 0 and count <= 0:
                out.append((*key, 0, "drop"))

        while waiting and waiting[0] < reached and not done:
            day = waiting.pop(0) // DAY_MS
            pass_by(day)
            count, expires = lifecycle.sighted(count, expires, day)
            if count >= lifecycle.PROMOTE:
                done, waiting = True, []
                out.append((*key, count, "promote"))
        if not done:
            pass_by(reached // DAY_MS)
        if done or count > 0 or waiting:
            state.update((count, expires, done, [] if done else waiting))
            if not done:
                next_day = [expires * DAY_MS] if count > 0 else []
                state.setTimeoutTimestamp(max(reached + 1, min([*waiting[:1], *next_day])))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["subject", "rel_type", "object", "hits", "outcome"])

    ship(stream.sparkSession)
    return (
        stream.withWatermark("ts", late)
        .groupBy("subject", "rel_type", "object")
        .applyInPandasWithState(run, "subject string, rel_type string, object string, hits long, outcome string", "hits long, expires long, done boolean, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Write all that is available as Parquet, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def maintain(stream: DataFrame, fold, path: str, checkpoint: str, refold: bool = False):
    """After each micro-batch, a fresh view of the log so far: ``path``/log and ``path``/view-<batch>.

    A fold whose own output can be folded on with new rows (least, greatest, union) is given with ``refold``: each view
    then comes from the one before it and the batch alone, and the log is written but not read again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        if refold:
            fresh = fold(rows)
            if number:
                last = spark.read.parquet(f"{path}/view-{number - 1}")
                fresh = fold(last.unionByName(fresh.select(*last.columns)))
        else:
            fresh = fold(spark.read.parquet(f"{path}/log"))
        fresh.write.mode("overwrite").parquet(f"{path}/view-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
