"""Lifecycle of staged facts and replays of the control plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import lifecycle
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

LOG = f"WITH {src.ASSERTIONS}"
NOW = "2024-02-20"


# The hits of a triple that is idle from day e until day d: one less for each 30 days begun, not below 0.
IDLE = "greatest(0, {a}.h - CASE WHEN {d} >= {a}.e THEN CAST(({d} - {a}.e) AS INT) // 30 + 1 ELSE 0 END)"


@register(
    "hit_lifecycle",
    f"""{LOG}, s AS (SELECT subject, rel_type, object, list_reduce(list({{'d': CAST(ts AS DATE), 'h': 1, 'e': CAST(ts AS DATE) + 30, 'p': false}} ORDER BY ts, id), lambda a, x: {{
            'd': x.d, 'h': CASE WHEN a.p THEN a.h + 1 ELSE {IDLE.format(a='a', d='x.d')} + 1 END, 'e': x.e, 'p': a.p OR {IDLE.format(a='a', d='x.d')} + 1 >= 3}}) AS x FROM assertions GROUP BY ALL),
        f AS (SELECT subject, rel_type, object, x.p AS done, CASE WHEN x.p THEN x.h ELSE {IDLE.format(a='x', d=f"DATE '{NOW}'")} END AS hits FROM s)
    SELECT subject, rel_type, object, CAST(hits AS BIGINT) AS hits, CASE WHEN done THEN 'promote' WHEN hits <= 0 THEN 'drop' ELSE 'keep' END AS outcome FROM f""",
)
def hit_lifecycle(spark, folder):
    return lifecycle.hits(src.assertions(spark, folder), NOW)


@register(
    "promote_policy",
    f"""{LOG}, f AS (SELECT subject, rel_type, object, count(*) AS confirmed, count(DISTINCT CAST(ts AS DATE)) AS sessions, bool_or(provenance = 'user_stated') AS own FROM assertions GROUP BY ALL)
    SELECT subject, rel_type, object, confirmed, sessions, CASE WHEN own THEN 'user' ELSE 'repeat' END AS policy FROM f WHERE confirmed >= 3 OR own""",
)
def promote_policy(spark, folder):
    return lifecycle.promotions(src.assertions(spark, folder))


@register("expire_ttl", f"{LOG} SELECT id, fact_class, ts FROM assertions WHERE fact_class <> 'C' OR DATE '2024-02-10' - CAST(ts AS DATE) < 30")
def expire_ttl(spark, folder):
    return lifecycle.unexpired(src.assertions(spark, folder), "2024-02-10").select("id", "fact_class", "ts")


@register(
    "sliding_rate",
    f"""{LOG}, w AS (SELECT id, subject, count(*) OVER (PARTITION BY subject ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS held FROM assertions)
    SELECT *, held > 2 AS limited FROM w""",
)
def sliding_rate(spark, folder):
    return lifecycle.sliding_rate(src.assertions(spark, folder), "subject", 6 * 3600, 2).select("id", "subject", "held", "limited")


@register(
    "dedup_window",
    f"""{LOG}, k AS (SELECT subject, rel_type, list_reduce(list({{'t': ts, 's': false, 'l': [id]}} ORDER BY ts, id), lambda a, x: CASE WHEN x.t - a.t >= INTERVAL 12 HOUR THEN {{'t': x.t, 's': false, 'l': list_concat(a.l, x.l)}} ELSE a END) AS r FROM assertions GROUP BY ALL),
        i AS (SELECT unnest(r.l) AS id FROM k)
    SELECT id, subject, rel_type, ts FROM assertions JOIN i USING (id)""",
)
def dedup_window(spark, folder):
    """Events that are admitted: 12 hours or more after the last admitted one."""
    return lifecycle.dedup_window(src.assertions(spark, folder).select("id", "subject", "rel_type", "ts"), ["subject", "rel_type"], 12 * 3600).select("id", "subject", "rel_type", "ts")


@register(
    "dedup_override",
    f"""{LOG}, k AS (SELECT subject, list_reduce(list({{'t': ts, 's': rel_type = 'error', 'l': [id]}} ORDER BY ts, id), lambda a, x: CASE WHEN x.t - a.t >= INTERVAL 12 HOUR OR (x.s AND NOT a.s) THEN {{'t': x.t, 's': x.s, 'l': list_concat(a.l, x.l)}} ELSE a END) AS r FROM assertions GROUP BY ALL)
    SELECT subject, unnest(r.l) AS id FROM k""",
)
def dedup_override(spark, folder):
    """Admitted events of each subject; an error takes the place of a standing claim that is none."""
    log = src.assertions(spark, folder).select("id", "subject", "rel_type", "ts")
    return lifecycle.dedup_window(log, ["subject"], 12 * 3600, F.col("rel_type") == "error").select("subject", "id")


@register(
    "daily_budget",
    f"""{LOG}, k AS (SELECT subject, list_reduce(list({{'t': ts, 'u': CASE WHEN true THEN 1 ELSE 0 END, 'f': rel_type = 'error', 'o': [{{'id': id, 'g': true, 'u': 1}}]}} ORDER BY ts, id),
            lambda a, x: CASE WHEN x.t >= a.t + INTERVAL 24 HOUR THEN {{'t': x.t, 'u': 1, 'f': x.f, 'o': list_concat(a.o, x.o)}}
                WHEN x.f OR a.u + 1 <= 3 THEN {{'t': a.t, 'u': a.u + 1, 'f': x.f, 'o': list_concat(a.o, [{{'id': x.o[1].id, 'g': true, 'u': a.u + 1}}])}}
                ELSE {{'t': a.t, 'u': a.u, 'f': x.f, 'o': list_concat(a.o, [{{'id': x.o[1].id, 'g': false, 'u': a.u}}])}} END) AS r FROM assertions GROUP BY ALL),
        o AS (SELECT subject, unnest(r.o) AS o FROM k)
    SELECT subject, o.id AS id, o.g AS granted, CAST(o.u AS BIGINT) AS used, CAST(CASE WHEN o.g THEN greatest(3 - o.u, 0) ELSE 0 END AS BIGINT) AS remaining FROM o""",
)
def daily_budget(spark, folder):
    """Three events a day and subject; errors are forced."""
    return lifecycle.daily_budget(src.assertions(spark, folder), "subject", 3, 24 * 3600, F.col("rel_type") == "error")


@register(
    "circuit_breaker",
    f"""{LOG}, k AS (SELECT subject, list_reduce(list({{'t': ts, 'n': CASE WHEN rel_type IN ('error', 'view') THEN 1 ELSE 0 END, 'o': [{{'id': id, 'p': true, 'n': CASE WHEN rel_type IN ('error', 'view') THEN 1 ELSE 0 END}}]}} ORDER BY ts, id),
            lambda a, x: CASE WHEN a.n >= 3 AND x.t - a.t < INTERVAL 36 HOUR THEN {{'t': a.t, 'n': a.n, 'o': list_concat(a.o, [{{'id': x.o[1].id, 'p': false, 'n': a.n}}])}}
                WHEN x.n = 1 THEN {{'t': x.t, 'n': a.n + 1, 'o': list_concat(a.o, [{{'id': x.o[1].id, 'p': true, 'n': a.n + 1}}])}}
                ELSE {{'t': x.t, 'n': 0, 'o': list_concat(a.o, x.o)}} END) AS r FROM assertions GROUP BY ALL),
        o AS (SELECT subject, unnest(r.o) AS o FROM k)
    SELECT subject, o.id AS id, o.p AS passed, CAST(o.n AS BIGINT) AS failures FROM o""",
)
def circuit_breaker(spark, folder):
    """Errors and views count as failures; three shut the breaker for 36 hours after the last."""
    return lifecycle.circuit_breaker(src.assertions(spark, folder), "subject", F.col("rel_type").isin("error", "view"), 3, 36 * 3600)


@register("stale_heartbeats", f"{LOG} SELECT subject, max(ts) AS last_seen FROM assertions GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 5 MINUTE")
def stale_heartbeats(spark, folder):
    return lifecycle.stale(src.assertions(spark, folder), "subject", "2024-01-30 00:00:00", 300)


@register(
    "admission_concurrency",
    f"""{LOG}, m AS (SELECT CAST(ts AS DATE) AS day, id, ts AS moment, 1 AS step FROM assertions UNION ALL SELECT CAST(ts AS DATE), id, ts + INTERVAL 30 MINUTE, -1 FROM assertions),
        r AS (SELECT *, sum(step) OVER (ORDER BY moment, step, id ROWS UNBOUNDED PRECEDING) AS busy FROM m)
    SELECT day, CAST(max(busy) AS BIGINT) AS peak, CAST(sum(CAST(busy > 8 AS INT)) AS BIGINT) AS shed FROM r WHERE step = 1 GROUP BY day""",
)
def admission_concurrency(spark, folder):
    """The overlap of work, were none shed: one running sum over all time, so work that runs over midnight counts on the next day."""
    return lifecycle.concurrency(src.assertions(spark, folder), 1800, 8)


@register("admission_barrier")
def admission_barrier(spark, folder):
    """What a barrier of eight slots for each type of event, with a minute's grace, makes of half an hour's work each."""
    return lifecycle.admitted(src.assertions(spark, folder), "rel_type", 1800, 8, 60)


@register(
    "token_bucket_replay",
    f"""{LOG}, k AS (SELECT subject, list_reduce(list({{'t': epoch_us(ts), 'b': 14400000000, 'o': [{{'id': id, 'b': 14400000000}}]}} ORDER BY ts, id), lambda a, x: {{
            't': x.t, 'b': least(21600000000, a.b + x.t - a.t) - 7200000000, 'o': list_concat(a.o, [{{'id': x.o[1].id, 'b': least(21600000000, a.b + x.t - a.t) - 7200000000}}])}}) AS r FROM assertions GROUP BY ALL),
        o AS (SELECT subject, unnest(r.o) AS o FROM k)
    SELECT o.id AS id, subject, round(greatest(o.b, 0) / 7200000000.0::DOUBLE, 6) AS "left", round(greatest(-o.b, 0) / 1000000.0::DOUBLE, 6) AS wait FROM o""",
)
def token_bucket_replay(spark, folder):
    """Tokens left and waits; a token takes two hours, so the balance is kept in microseconds of refill."""
    return lifecycle.token_bucket(src.assertions(spark, folder), "subject", 1 / 7200, 3.0)


@register("tumbling_counts", f"{LOG} SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, rel_type, count(*) AS n, round(sum(value), 4) AS total FROM assertions GROUP BY ALL")
def tumbling_counts(spark, folder):
    return lifecycle.window_counts(src.assertions(spark, folder), "1 day")


@register(
    "sliding_counts",
    f"""{LOG}, s AS (SELECT *, unnest([0, 1]) AS back FROM assertions)
    SELECT time_bucket(INTERVAL 12 HOUR, ts) - back * INTERVAL 12 HOUR AS start, rel_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""",
)
def sliding_counts(spark, folder):
    return lifecycle.window_counts(src.assertions(spark, folder), "1 day", "12 hours")


@register(
    "session_counts",
    f"""{LOG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM assertions WINDOW w AS (PARTITION BY subject ORDER BY ts, id)),
        n AS (SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT subject, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY subject, session""",
)
def session_counts(spark, folder):
    return lifecycle.sessions(src.assertions(spark, folder), "subject", 6 * 3600).withColumn("session", F.col("session").cast("long"))
