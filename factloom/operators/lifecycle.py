"""Lifecycle of staged facts, and replays of the control plane over event logs."""

from __future__ import annotations

import datetime as dt
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.replay import replay

PROMOTE, IDLE_DAYS, TTL_DAYS, BUCKET_SECONDS = 3, 30, 30, 600


def aged(count: int, expires: int, day: int) -> tuple[int, int]:
    """Hits and their day of expiry after the idle spells up to a day: each takes one hit and begins another."""
    while count > 0 and expires <= day:
        count, expires = count - 1, expires + IDLE_DAYS
    return count, expires


def sighted(count: int, expires: int, day: int) -> tuple[int, int]:
    """The same after a sighting on a day."""
    return aged(count, expires, day)[0] + 1, day + IDLE_DAYS


def hits(log: DataFrame, now: str) -> DataFrame:
    """Hits of each triple and what becomes of it.

    A sighting creates it with one hit, or adds one; 30 days without any take one
    away and begin another 30.  It is promoted for good at three hits and dropped
    at none; a sighting after that creates it anew.
    """
    until = (dt.date.fromisoformat(now) - dt.date(1970, 1, 1)).days

    def sight(state: dict, event: dict) -> None:
        count, expires = state["hits"], state["expires"]
        state["hits"], state["expires"] = (count + 1, expires) if state["done"] else sighted(count, expires, event["day"])
        state["done"] = state["done"] or state["hits"] >= PROMOTE

    def ended(state: dict) -> dict:
        count = state["hits"] if state["done"] else aged(state["hits"], state["expires"], until)[0]
        return {"hits": count, "outcome": "promote" if state["done"] else "drop" if count <= 0 else "keep"}

    triple = ["subject", "rel_type", "object"]
    rows = log.select(*triple, "ts", "id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"))
    fresh = lambda: {"hits": 0, "expires": 0, "done": False}
    return replay(rows, triple, fresh, sight, "subject string, rel_type string, object string, hits long, outcome string", ended, given=["day"])


def promotions(log: DataFrame) -> DataFrame:
    """Staged triples that a policy promotes: three confirmations, or the user's own word."""
    folded = log.groupBy("subject", "rel_type", "object").agg(F.count("*").alias("confirmed"), F.count_distinct(F.to_date("ts")).alias("sessions"), F.bool_or(F.col("provenance") == "user_stated").alias("own"))
    return folded.where((F.col("confirmed") >= PROMOTE) | F.col("own")).select("subject", "rel_type", "object", "confirmed", "sessions", F.when(F.col("own"), F.lit("user")).otherwise(F.lit("repeat")).alias("policy"))


def unexpired(log: DataFrame, now: str) -> DataFrame:
    """Rows that live on: classes A and B always, C for 30 days."""
    return log.where((F.col("fact_class") != "C") | (F.datediff(F.to_date(F.lit(now)), F.to_date("ts")) < TTL_DAYS))


def sliding_rate(log: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Each event's number of events of its key in the window up to it, and whether that exceeds the limit."""
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy(key).orderBy("moment").rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("moment", moment).withColumn("held", F.count("*").over(window)).withColumn("limited", F.col("held") > limit).drop("moment")


def dedup_window(log: DataFrame, key: list[str], seconds: int, overriding: Column | None = None) -> DataFrame:
    """Events that claim their key: no claim stands, it has stood for the window, or an ``overriding`` event meets one that is not."""
    rows = log.withColumn("strong", F.coalesce(overriding, F.lit(False)) if overriding is not None else F.lit(False))
    span = dt.timedelta(seconds=seconds)

    def claim(state: dict, event: dict) -> dict | None:
        free = state["at"] is None or event["ts"] - state["at"] >= span
        if not (free or (event["strong"] and not state["strong"])):
            return None
        state.update(at=event["ts"], strong=event["strong"])
        return event

    names = [c for c in log.columns if c not in key]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, *names])
    return replay(rows, key, lambda: {"at": None, "strong": False}, claim, schema)


def admitted(log: DataFrame, key: str, seconds: int, slots: int, grace: int) -> DataFrame:
    """(id, key, admitted, waited, busy) of every event of work at a barrier per key: who gets a slot, after how many seconds, and how many were taken as it came.

    An event takes a free slot at once.  If none is free it waits for the first
    that falls free within the grace, else it is shed and takes none.
    """

    def arrive(state: dict, event: dict) -> dict:
        ends, at = state["ends"], event["at"]
        while ends and ends[0] <= at:
            heapq.heappop(ends)
        busy, wait = len(ends), 0
        if busy >= slots:
            wait = ends[0] - at
            if wait > grace * 1_000_000:
                return {"id": event["id"], "admitted": False, "waited": None, "busy": busy}
            heapq.heappop(ends)
        heapq.heappush(ends, at + wait + seconds * 1_000_000)
        return {"id": event["id"], "admitted": True, "waited": wait / 1e6, "busy": busy}

    rows = log.select("id", key, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return replay(rows, [key], lambda: {"ends": []}, arrive, f"id long, {key} string, admitted boolean, waited double, busy long", given=["id", "at"])


def concurrency(log: DataFrame, seconds: int, slots: int, restart: bool = False) -> DataFrame:
    """(day, peak, shed): most events at work at once as one of each day began, and how many were more than the slots, were none of them shed.

    Work that runs over midnight counts on the next day too, unless the count is to ``restart`` with the events of each
    day.  Sums run inside buckets of ten minutes; a prefix sum over the buckets' totals gives what each begins with.
    """
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    work = log.select(F.to_date("ts").alias("day"), "id", begin.alias("at"))
    marks = work.select("day", "id", "at", F.lit(1).alias("step")).unionByName(work.select("day", "id", (F.col("at") + seconds * 1_000_000).alias("at"), F.lit(-1).alias("step")))
    run = F.col("day") if restart else F.lit(None).cast("date")
    marks = marks.withColumn("run", run).withColumn("bucket", F.expr(f"div(at, {BUCKET_SECONDS * 1_000_000}L)"))
    totals = marks.groupBy("run", "bucket").agg(F.sum("step").alias("net"))
    before = F.sum("net").over(Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("run", "bucket", F.coalesce(before, F.lit(0)).alias("before")).alias("t")
    inside = F.sum("step").over(Window.partitionBy("run", "bucket").orderBy("at", "step", "id").rowsBetween(Window.unboundedPreceding, 0))
    begun = marks.withColumn("inside", inside).where("step = 1").alias("m").join(totals, F.expr("m.run <=> t.run and m.bucket = t.bucket"))
    return begun.withColumn("busy", F.col("before") + F.col("inside")).groupBy("day").agg(F.max("busy").alias("peak"), F.sum((F.col("busy") > slots).cast("long")).alias("shed"))


def token_bucket(log: DataFrame, key: str, rate: float, capacity: float) -> DataFrame:
    """Replay of a token bucket per key, served in order: what is left after each event, and how long it waits.

    The tokens that the n-th event finds missing are 1 and the most that any run of
    events up to it asks beyond the refill in that run; so they are a running
    maximum, and no event's wait spends a token that another waits for.
    """
    cost = round(1e6 / rate)  # microseconds a token, so that all sums are whole numbers
    order = Window.partitionBy(key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.select("id", key, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.count("*").over(order) * cost).alias("asked"))
    missing = F.col("asked") + cost - F.col("at") + F.max(F.col("at") - F.col("asked")).over(order)
    balance = (F.lit(round(capacity * cost)) - missing).alias("balance")
    rows = rows.select("id", key, balance)
    return rows.select("id", key, F.round(F.greatest("balance", F.lit(0)) / cost, 6).alias("left"), F.round(F.greatest(-F.col("balance"), F.lit(0)) / 1e6, 6).alias("wait"))


def daily_budget(log: DataFrame, key: str, cap: int, seconds: int, forced: Column) -> DataFrame:
    """Spending of one per event against a budget that opens with the first event and is new after its window; forced events count past the cap."""
    span = dt.timedelta(seconds=seconds)

    def spend(state: dict, event: dict) -> dict:
        if state["opened"] is None or event["ts"] >= state["opened"] + span:
            state.update(opened=event["ts"], used=0)
        granted = event["forced"] or state["used"] + 1 <= cap
        state["used"] += granted
        return {"id": event["id"], "granted": granted, "used": state["used"], "remaining": max(cap - state["used"], 0) if granted else 0}

    rows = log.select("id", key, "ts", F.coalesce(forced, F.lit(False)).alias("forced"))
    return replay(rows, [key], lambda: {"opened": None, "used": 0}, spend, f"id long, {key} string, granted boolean, used long, remaining long")


def circuit_breaker(log: DataFrame, key: str, failed: Column, threshold: int = 3, seconds: int = 60) -> DataFrame:
    """Whether each call of a key was let through: not while there are ``threshold`` failures and the last is younger than the timeout; a success forgets them."""
    span = dt.timedelta(seconds=seconds)

    def call(state: dict, event: dict) -> dict:
        shut = state["failures"] >= threshold and event["ts"] - state["last"] < span
        if not shut:
            state.update(failures=state["failures"] + 1, last=event["ts"]) if event["failed"] else state.update(failures=0, last=None)
        return {"id": event["id"], "passed": not shut, "failures": state["failures"]}

    rows = log.select("id", key, "ts", F.coalesce(failed, F.lit(False)).alias("failed"))
    return replay(rows, [key], lambda: {"failures": 0, "last": None}, call, f"id long, {key} string, passed boolean, failures long")


def stale(log: DataFrame, key: str, now: str, seconds: int) -> DataFrame:
    """Keys whose latest sign of life is older than the limit."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return log.groupBy(key).agg(F.max("ts").alias("last_seen")).where(F.col("last_seen") < limit)


def window_counts(log: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events and their values per event-time window and relation."""
    return log.groupBy(F.window(F.col("ts").cast("timestamp"), width, slide or width), "rel_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "rel_type", "n", "total")


def sessions(log: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Sessions of a key: runs of events with no gap longer than the given one."""
    order = Window.partitionBy(key).orderBy("ts", "id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    opens = F.when(micros - F.lag(micros).over(order) <= gap_seconds * 1_000_000, 0).otherwise(1)
    number = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("opens", opens).withColumn("session", number).groupBy(key, "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
