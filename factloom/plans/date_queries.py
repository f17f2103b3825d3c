"""Dates that text names: relative phrases, calendar windows, named days, offsets, clocks and gaps.

The driver tables hold no such phrases, so every order gets one of a fixed list, read against its own date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import dates
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

RELATIVE = [
    "I fixed the fence three weeks ago",
    "trimmed the hooves 2 weeks ago",
    "a couple of months ago I adopted a cat",
    "I will move in two weeks",
    "we met a year ago",
    "the outage was on 2001-01-01, not yesterday",
    "I called the vet yesterday",
    "I am moving today",
    "the appointment is tomorrow",
    "I saw them last Thursday",
    "the meeting is next Monday",
    "I changed jobs recently",
    "I will move next month",
    "that happened long ago",
    "in 14 days it is over",
]
WINDOWS = ["last week", " This Month ", "next year", "previous year", "current week", "upcoming month", "last week of 2020", "week", "past month", "coming week"]
NAMED = [
    "Black Friday",
    "the day after Christmas Eve",
    "a week before Black Friday",
    "2 months after New Year's Day",
    "10 days prior to Halloween",
    "a year before Thanksgiving",
    "on July 4th",
    "Boxing Day sales",
    "a fortnight after Cyber Monday",
    "an hour before Christmas",
    "nothing of the kind",
    "three days before Valentine's Day",
]
MARKED = ["[Date: 2023/03/10] it rained", "[Date: 2020-02-29]  leap", "no marker here", "[Date: soon] unclear", "later [Date: 2021/01/01] in the text"]
OBJECTS = ["two weeks ago", "yesterday", "2020-03-22", "fence", "", "last thursday", "brown swiss", "in 3 days", "a day trip"]


def phrases(spark, folder, texts: list[str]):
    """o_orderkey, day, text: fixed phrases dealt to the orders and their days, and all that conversations and documents say, on a day of 2024 each."""
    pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    dealt = src.table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), pick.alias("text"))
    turns = src.table(spark, folder, "conversations").select((-1 - 2 * (F.col("conv_id") * 1000 + F.col("turn"))).alias("o_orderkey"), "text")
    every = turns.unionByName(src.table(spark, folder, "documents").select((-2 - 2 * F.col("doc_id")).alias("o_orderkey"), "text"))
    return dealt.unionByName(every.select("o_orderkey", F.date_add(F.lit("2024-01-01").cast("date"), (-F.col("o_orderkey") % 366).cast("int")).alias("day"), "text"))


def _phrases_sql(texts: list[str]) -> str:
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"""p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, [{listed}][o_orderkey % {len(texts)} + 1] AS text FROM orders UNION ALL SELECT k, DATE '2024-01-01' + CAST(-k % 366 AS INT), text FROM (
        SELECT -1 - 2 * (conv_id * 1000 + turn) AS k, text FROM conversations UNION ALL SELECT -2 - 2 * doc_id, text FROM documents))"""


def _group(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _count_sql(word: str) -> str:
    listed = ", ".join(f"'{c}'" for c in dates.COUNTS)
    return f"CASE WHEN {word} IN ('a', 'an') THEN 1 WHEN {word} LIKE '%couple of' THEN 2 ELSE coalesce(list_position([{listed}], {word}), TRY_CAST({word} AS INT)) END"


def _shift_sql(day: str, count: str, unit: str) -> str:
    return f"CASE {unit} WHEN 'day' THEN {day} + CAST({count} AS INT) WHEN 'week' THEN {day} + CAST(7 * ({count}) AS INT) WHEN 'fortnight' THEN {day} + CAST(14 * ({count}) AS INT) WHEN 'month' THEN CAST({day} + to_months(CAST({count} AS INT)) AS DATE) WHEN 'year' THEN CAST({day} + to_months(CAST(12 * ({count}) AS INT)) AS DATE) END"


def _relative_sql(text: str, day: str) -> str:
    low = f"lower({text})"
    moved = lambda pattern, sign: _shift_sql(day, f"{sign} * ({_count_sql(_group(low, pattern, 1))})", _group(low, pattern, 2))
    names = ", ".join(f"'{w}'" for w in dates.WEEKDAYS)
    index = f"list_position([{names}], {_group(low, dates.WEEKDAY, 2)})"
    turn = _group(low, dates.WEEKDAY, 1)
    near = " ".join(f"WHEN regexp_matches({low}, '\\b{w}\\b') THEN {day} + {n}" for w, n in (("yesterday", -1), ("today", 0), ("tomorrow", 1)))
    return f"""coalesce({moved(dates.AGO, -1)}, {moved(dates.AHEAD, 1)}, CASE {near} END,
        CASE {turn} WHEN 'last' THEN {day} - CAST((isodow({day}) - {index} + 6) % 7 + 1 AS INT) WHEN 'next' THEN {day} + CAST(({index} - isodow({day}) + 6) % 7 + 1 AS INT) END)"""


def _point_sql(text: str, day: str) -> str:
    return f"coalesce(TRY_CAST({_group(text, dates.ISO, 1)} AS DATE), {_relative_sql(text, day)})"


@register("relative_dates", f"WITH {_phrases_sql(RELATIVE)}, d AS (SELECT *, {_point_sql('text', 'day')} AS found FROM p) SELECT o_orderkey, text, found, CASE WHEN found < day THEN 'past' WHEN found > day THEN 'future' ELSE 'now' END AS status FROM d")
def relative_dates(spark, folder):
    """The day that each phrase names, and whether that is past, now or future."""
    text, day = F.col("text"), F.col("day")
    return phrases(spark, folder, RELATIVE).select("o_orderkey", "text", dates.point(text, day).alias("found"), dates.status(text, day).alias("status"))


def _window_sql(text: str, day: str) -> str:
    """A list of [start, end) and a period, as three expressions."""
    low = f"lower({text})"
    word, period = _group(low, dates.WINDOW, 1), _group(low, dates.WINDOW, 2)
    offset = "CASE " + " ".join(f"WHEN {word} IN ({', '.join(repr(w) for w in ws)}) THEN {n}" for n, ws in dates.DIRECTIONS.items()) + " END"
    step = f"CASE {period} WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END"
    base = f"date_trunc({period}, {day})"
    return f"CASE WHEN {period} IS NOT NULL THEN CAST({base} + ({offset}) * ({step}) AS DATE) END", f"CASE WHEN {period} IS NOT NULL THEN CAST({base} + ({offset} + 1) * ({step}) AS DATE) END", period


@register("calendar_phrases", "WITH {}, w AS (SELECT o_orderkey, text, {} AS start, {} AS \"end\", {} AS granularity FROM p) SELECT *, granularity IS NOT NULL AS bare FROM w".format(_phrases_sql(WINDOWS), *_window_sql("text", "day")))
def calendar_phrases(spark, folder):
    """Bare calendar windows as [start, end)."""
    found = phrases(spark, folder, WINDOWS).withColumn("w", dates.window(F.col("text"), F.col("day")))
    return found.select("o_orderkey", "text", "w.start", "w.end", "w.granularity", dates.is_bare_window(F.col("text")).alias("bare"))


def _rule_sql(rule: tuple, year: str) -> str:
    if len(rule) == 2:
        return f"make_date({year}, {rule[0]}, {rule[1]})"
    weekday = [w[:3].title() for w in dates.WEEKDAYS].index(rule[1]) + 1
    first = f"make_date({year}, {rule[0]}, 1)"
    return f"CAST({first} + CAST(({weekday} - isodow({first}) + 7) % 7 + {7 * (rule[2] - 1) + rule[3]} AS INT) AS DATE)"


def _event_sql(text: str, day: str) -> tuple[str, str]:
    quoted = lambda n: "'" + n.replace("'", "''") + "'"
    name = "CASE " + " ".join(f"WHEN contains(lower({text}), {quoted(n)}) THEN {quoted(n)}" for n in dates.LONGEST_FIRST) + " END"
    one = lambda rule: f"CASE WHEN {_rule_sql(rule, f'year({day})')} <= {day} THEN {_rule_sql(rule, f'year({day})')} ELSE {_rule_sql(rule, f'(year({day}) - 1)')} END"
    return name, f"CASE {name} " + " ".join(f"WHEN {quoted(n)} THEN {one(rule)}" for n, rule in dates.EVENTS.items()) + " END"


def _offset_sql(text: str, day: str) -> str:
    low = f"lower(trim({text}))"
    unit = f"regexp_replace({_group(low, dates.OFFSET, 2)}, 's$', '')"
    sign = f"CASE WHEN {_group(low, dates.OFFSET, 3)} = 'after' THEN 1 ELSE -1 END"
    return _shift_sql(f"({_event_sql(_group(low, dates.OFFSET, 4), day)[1]})", f"({sign}) * ({_count_sql(_group(low, dates.OFFSET, 1))})", unit)


@register("named_days", "WITH {} SELECT o_orderkey, text, {} AS name, {} AS found, {} AS moved FROM p".format(_phrases_sql(NAMED), *_event_sql("text", "day"), _offset_sql("text", "day")))
def named_days(spark, folder):
    """The named day in each phrase, its latest occurrence, and the day that an offset from it names."""
    text, day = F.col("text"), F.col("day")
    return phrases(spark, folder, NAMED).select("o_orderkey", "text", dates.event_name(text).alias("name"), dates.event_date(text, day).alias("found"), dates.offset_date(text, day).alias("moved"))


EVERY = [*RELATIVE, *WINDOWS, *NAMED]


@register(
    "resolve_dates",
    """WITH {}, f AS (SELECT o_orderkey, text, {} AS w0, {} AS w1, {} AS wg, {} AS pt, {} AS mv, {} AS ev FROM p), d AS (SELECT *, coalesce(pt, mv, ev) AS day FROM f)
    SELECT o_orderkey, text, coalesce(w0, day) AS start, coalesce(w1, CAST(day + 1 AS DATE)) AS "end", coalesce(wg, CASE WHEN day IS NOT NULL THEN 'day' END) AS granularity,
        CASE WHEN w0 IS NOT NULL THEN 'window' WHEN pt IS NOT NULL THEN 'point' WHEN mv IS NOT NULL THEN 'offset' WHEN ev IS NOT NULL THEN 'named' END AS how FROM d""".format(
        _phrases_sql(EVERY), *_window_sql("text", "day"), _point_sql("text", "day"), _offset_sql("text", "day"), _event_sql("text", "day")[1]
    ),
)
def resolve_dates(spark, folder):
    """Every phrase as an interval: window, then point, then named day."""
    found = phrases(spark, folder, EVERY).withColumn("r", dates.resolved(F.col("text"), F.col("day")))
    return found.select("o_orderkey", "text", "r.start", "r.end", "r.granularity", "r.how")


@register(
    "reference_clock",
    f"""WITH {_phrases_sql(MARKED)} SELECT o_orderkey, coalesce(TRY_CAST(replace(trim({_group('text', dates.MARKER.replace("'", "''"), 1)}), '/', '-') AS DATE), day) AS reference,
        regexp_replace(text, '{dates.MARKER}', '') AS rest FROM p""",
)
def reference_clock(spark, folder):
    """The date that a leading marker sets, else the order's own, and the text without the marker."""
    reference, rest = dates.clock(F.col("text"), F.col("day"))
    return phrases(spark, folder, MARKED).select("o_orderkey", reference.alias("reference"), rest.alias("rest"))


@register(
    "temporal_objects",
    f"""WITH {_phrases_sql(OBJECTS)} SELECT o_orderkey, text AS object, regexp_matches(lower(text), '{dates.CUES}') AS cue FROM p
    WHERE NOT regexp_matches(trim(lower(text)), '^(?:{dates.ISO}|yesterday|today|tomorrow|{dates.AGO}|{dates.AHEAD}|{dates.WEEKDAY})$')""",
)
def temporal_objects(spark, folder):
    """Edges without those whose object is a date or relative time, and whether the gate of date cues lets each text through."""
    rows = phrases(spark, folder, OBJECTS).where(~dates.is_temporal(F.col("text")))
    return rows.select("o_orderkey", F.col("text").alias("object"), dates.has_date_cue(F.col("text")).alias("cue"))


@register(
    "signed_gaps",
    """WITH s AS (SELECT l_orderkey AS o_orderkey, CAST(min(l_shipdate) AS DATE) AS a0, CAST(max(l_shipdate) AS DATE) + 1 AS a1 FROM lineitem GROUP BY 1),
        q AS (SELECT s.*, CAST(o_orderdate AS DATE) AS b0 FROM s JOIN orders USING (o_orderkey)),
        g AS (SELECT o_orderkey, a1 - a0 AS width, CASE WHEN a1 - a0 = 1 THEN b0 - a0 END AS exact, greatest(0, CASE WHEN a0 <= b0 THEN b0 - (a1 - 1) ELSE a0 - b0 END) AS lo, CASE WHEN a0 <= b0 THEN b0 - a0 ELSE (a1 - 1) - b0 END AS hi FROM q)
    SELECT o_orderkey, CAST(width AS INT) AS width, CAST(exact AS INT) AS exact, CASE WHEN width > 1 THEN CAST(lo AS INT) END AS least, CASE WHEN width > 1 THEN CAST(greatest(lo, hi) AS INT) END AS most FROM g""",
)
def signed_gaps(spark, folder):
    """Days from an order's shipping to its date: exact and signed where all left on one day, else the least and most."""
    shipped = src.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("a0"), F.date_add(F.to_date(F.max("l_shipdate")), 1).alias("a1"))
    rows = shipped.join(src.table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("b0")), "o_orderkey")
    found = dates.gap(F.col("a0"), F.col("a1"), F.col("b0"), F.date_add("b0", 1))
    return rows.select("o_orderkey", dates.width(F.col("a0"), F.col("a1")).alias("width"), F.inline(F.array(found)))
