"""Dates and calendar windows that text names, against a reference date.

Every function is one native expression over a text column; nothing is guessed:
text that names no date gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators.temporal import calendar_window, nth_weekday

#: The words of a bare calendar window, by the period they point to.
DIRECTIONS = {-1: ["last", "previous", "prev", "past"], 0: ["this", "current"], 1: ["next", "coming", "upcoming", "following"]}
PERIODS = ["week", "month", "year"]

#: Named days as (month, day) or (month, weekday, n, days after it).
EVENTS = {
    "new year's day": (1, 1),
    "new years day": (1, 1),
    "new year": (1, 1),
    "valentine's day": (2, 14),
    "valentines day": (2, 14),
    "st patrick's day": (3, 17),
    "st. patrick's day": (3, 17),
    "halloween": (10, 31),
    "christmas eve": (12, 24),
    "christmas": (12, 25),
    "christmas day": (12, 25),
    "new year's eve": (12, 31),
    "new years eve": (12, 31),
    "independence day": (7, 4),
    "fourth of july": (7, 4),
    "july 4th": (7, 4),
    "thanksgiving": (11, "Thu", 4, 0),
    "black friday": (11, "Thu", 4, 1),
    "cyber monday": (11, "Thu", 4, 4),
    "boxing day": (12, 26),
}
LONGEST_FIRST = sorted(EVENTS, key=len, reverse=True)

#: Counts and units of relative phrases.
_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
COUNTS = _ONES + [w for ten in _TENS for w in (ten, *[f"{ten}-{one}" for one in _ONES[:9]])]  # one to ninety-nine
UNIT_DAYS = {"day": 1, "week": 7, "fortnight": 14}
UNIT_MONTHS = {"month": 1, "year": 12}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

WINDOW = rf"^\s*({'|'.join(w for ws in DIRECTIONS.values() for w in ws)})\s+({'|'.join(PERIODS)})\s*$"
_COUNT = rf"(\d+|a couple of|couple of|an|a|{'|'.join(sorted(COUNTS, key=len, reverse=True))})"
AGO = rf"\b{_COUNT}\s+(day|week|fortnight|month|year)s?\s+ago\b"
AHEAD = rf"\bin\s+{_COUNT}\s+(day|week|fortnight|month|year)s?\b"
WEEKDAY = rf"\b(last|next)\s+({'|'.join(WEEKDAYS)})\b"
ISO = r"\b(\d{4}-\d{2}-\d{2})\b"
OFFSET = r"\b(an|a|\d+)\s+([a-z]+)\s+(before|after|prior\s+to)\s+(.+)$"
CUES = rf"{ISO}|\b(?:19|20)\d{{2}}\b|\b(?:yesterday|today|tomorrow)\b|{AGO}|{AHEAD}|{WEEKDAY}"
MARKER = r"^\s*\[Date:\s*([^\]]+)\]\s*"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(text: Column, pattern: str, group: int) -> Column:
    return _let(F.regexp_extract(text, pattern, group), lambda hit: F.when(hit != "", hit))


def is_bare_window(text: Column) -> Column:
    """Whether the whole text is a direction and a period."""
    return F.coalesce(F.lower(text).rlike(WINDOW), F.lit(False))


def window(text: Column, reference: Column, first: int = 0) -> Column:
    """(start, end, granularity) of a bare calendar window, [start, end) aligned to the calendar."""

    def of(direction: Column, period: Column) -> Column:
        offset = F.coalesce(*[F.when(direction.isin(words), n) for n, words in DIRECTIONS.items()])
        bounds = [calendar_window(reference, name, offset, first) for name in PERIODS]
        return F.coalesce(*[F.when(period == name, F.struct(start.alias("start"), end.alias("end"), F.lit(name).alias("granularity"))) for name, (start, end) in zip(PERIODS, bounds)])

    read = lambda low: F.struct(*[F.regexp_extract(low, WINDOW, g).alias(name) for g, name in ((1, "direction"), (2, "period"))])
    return _let(F.lower(text), lambda low: F.when(low.rlike(WINDOW), _let(read(low), lambda w: of(w["direction"], w["period"]))))


def _event_in(rule: tuple, year: Column) -> Column:
    if len(rule) == 2:
        return F.make_date(year, F.lit(rule[0]), F.lit(rule[1]))
    return F.date_add(nth_weekday(year, *rule[:3]), rule[3])


def event_name(text: Column) -> Column:
    """The longest named day in the text."""
    return _let(F.lower(text), lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(name)), F.lit(name)) for name in LONGEST_FIRST]))


def event_date(text: Column, reference: Column) -> Column:
    """The most recent occurrence, on or before the reference, of the day that the text names."""

    def recent(rule: tuple) -> Column:
        now = _event_in(rule, F.year(reference))
        return F.when(now <= reference, now).otherwise(_event_in(rule, F.year(reference) - 1))

    rules = dict.fromkeys(EVENTS.values())
    return _let(event_name(text), lambda name: F.coalesce(*[F.when(name.isin([n for n in EVENTS if EVENTS[n] == rule]), recent(rule)) for rule in rules]))


def _shifted(day: Column, count: Column, unit: Column) -> Column:
    """The day moved by count units; the day of the month is clamped to the month's length."""
    days = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in UNIT_DAYS.items()])
    months = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in UNIT_MONTHS.items()])
    return F.coalesce(F.date_add(day, count * days), F.add_months(day, count * months))


def _count(word: Column) -> Column:
    listed = F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(COUNTS) for x in (c, i + 1)]), word)
    return F.coalesce(F.when(word.isin("a", "an"), 1), F.when(word.like("%couple of"), 2), listed, word.try_cast("int"))


def offset_date(text: Column, reference: Column) -> Column:
    """A count of units before or after a named day."""
    groups = ("count", "unit", "side", "event")

    def moved(m: Column) -> Column:
        sign = F.when(m["side"] == "after", 1).otherwise(-1)
        return _shifted(event_date(m["event"], reference), sign * _count(m["count"]), F.regexp_replace(m["unit"], "s$", ""))

    # The pattern runs once over a text, and its groups are read from what it matched.
    read = lambda hit: F.struct(*[F.regexp_extract(hit, OFFSET, g).alias(name) for g, name in enumerate(groups, 1)])
    of = lambda hit: F.when(hit != "", _let(read(hit), moved))
    may = lambda low: F.contains(low, F.lit("before")) | F.contains(low, F.lit("after")) | F.contains(low, F.lit("prior"))
    return _let(F.lower(F.trim(text)), lambda low: F.when(may(low), _let(F.regexp_extract(low, OFFSET, 0), of)))


def relative_date(text: Column, reference: Column) -> Column:
    """The day of a relative phrase: some units ago or ahead, yesterday, today, tomorrow, the last or next weekday."""
    return _let(F.lower(text), lambda low: _relative(low, reference))


def _relative(low: Column, reference: Column) -> Column:
    def moved(pattern: str, sign: int, must: str) -> Column:
        of = lambda hit: F.when(hit != "", _shifted(reference, sign * _count(F.regexp_extract(hit, pattern, 1)), F.regexp_extract(hit, pattern, 2)))
        return F.when(F.contains(low, F.lit(must)), _let(F.regexp_extract(low, pattern, 0), of))

    def turned(hit: Column) -> Column:
        weekday = F.substring(F.regexp_extract(hit, WEEKDAY, 2), 1, 3)
        return F.when(F.startswith(hit, F.lit("last")), F.call_function("next_day", F.date_sub(reference, 8), weekday)).when(hit != "", F.call_function("next_day", reference, weekday))

    near = lambda word, days: F.when(F.contains(low, F.lit(word)) & low.rlike(rf"\b{word}\b"), F.date_add(reference, days))
    turn = F.when(F.contains(low, F.lit("day")), _let(F.regexp_extract(low, WEEKDAY, 0), turned))
    return F.coalesce(moved(AGO, -1, "ago"), moved(AHEAD, 1, "in"), near("yesterday", -1), near("today", 0), near("tomorrow", 1), turn)


def point(text: Column, reference: Column) -> Column:
    """A written ISO date, else a relative one."""
    return F.coalesce(_part(text, ISO, 1).try_cast("date"), relative_date(text, reference))


def resolved(text: Column, reference: Column) -> Column:
    """(start, end, granularity, how): a bare window, else a point, else a named day with or without an offset; a point is one day."""
    one = lambda start, end, grain, kind: F.struct(start.alias("start"), end.alias("end"), grain.alias("granularity"), kind.alias("how"))
    day = lambda at, kind: F.when(at.isNotNull(), one(at, F.date_add(at, 1), F.lit("day"), F.lit(kind)))
    whole = lambda w: F.when(w.isNotNull(), one(w["start"], w["end"], w["granularity"], F.lit("window")))
    return F.coalesce(
        _let(window(text, reference), whole),
        _let(point(text, reference), lambda at: day(at, "point")),
        _let(offset_date(text, reference), lambda at: day(at, "offset")),
        _let(event_date(text, reference), lambda at: day(at, "named")),
    )


def status(text: Column, reference: Column) -> Column:
    """past, now or future of the day that the text names; text that names none, a vague one included, is now."""
    day = point(text, reference)
    return F.when(day < reference, F.lit("past")).when(day > reference, F.lit("future")).otherwise(F.lit("now"))


def is_temporal(text: Column) -> Column:
    """Whether the text is a date or relative time and so no object of a relation."""
    return F.coalesce(F.trim(F.lower(text)).rlike(rf"^(?:{ISO}|yesterday|today|tomorrow|{AGO}|{AHEAD}|{WEEKDAY})$"), F.lit(False))


def has_date_cue(text: Column, pattern: str = CUES) -> Column:
    """Whether any of the active date patterns matches."""
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def union_of(patterns: list[str]) -> str:
    """One pattern of all that compile; the others are left out."""
    import re

    kept = []
    for one in patterns:
        try:
            re.compile(one)
        except re.error:
            continue
        kept.append(f"(?:{one})")
    return "|".join(kept) or r"[^\s\S]"


def clock(text: Column, now: Column) -> tuple[Column, Column]:
    """The reference date of a leading ``[Date: y/m/d]`` marker, else now; and the text without the marker."""
    written = F.regexp_replace(F.trim(_part(text, MARKER, 1)), "/", "-").try_cast("date")
    return F.coalesce(written, now), F.regexp_replace(F.coalesce(text, F.lit("")), MARKER, "")


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """(exact, least, most) days from a to b: exact and signed between two days, else the least and most that the intervals allow."""
    points = (F.datediff(a_end, a_start) == 1) & (F.datediff(b_end, b_start) == 1)
    forward = a_start <= b_start
    e_start, e_end = F.when(forward, a_start).otherwise(b_start), F.when(forward, a_end).otherwise(b_end)
    l_start, l_end = F.when(forward, b_start).otherwise(a_start), F.when(forward, b_end).otherwise(a_end)
    least = F.greatest(F.lit(0), F.datediff(l_start, F.date_sub(e_end, 1)))
    most = F.greatest(least, F.datediff(F.date_sub(l_end, 1), e_start))
    return F.struct(F.when(points, F.datediff(b_start, a_start)).alias("exact"), F.when(~points, least).alias("least"), F.when(~points, most).alias("most"))


def width(start: Column, end: Column) -> Column:
    """Days of an interval; a point has one."""
    return F.datediff(end, start)
