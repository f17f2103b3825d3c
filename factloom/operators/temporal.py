"""Calendar windows, named days, durations and order of dated facts.

Intervals are half-open [start, end) pairs of dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_start(day: Column, first: int = 0) -> Column:
    """The start of the day's week; first is 0 for Monday, 6 for Sunday."""
    return F.date_sub(day, (F.weekday(day) - first + 7) % 7)


def calendar_window(day: Column, period: str, offset: int | Column, first: int = 0) -> tuple[Column, Column]:
    """[start, end) of the week, month or year ``offset`` periods from the day's."""
    if period == "week":
        start = F.date_add(week_start(day, first), 7 * offset)
        return start, F.date_add(start, 7)
    months = {"month": 1, "year": 12}[period]
    start = F.add_months(F.trunc(day, period), months * offset)
    return start, F.add_months(start, months)


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """The n-th such weekday of the month; n = -1 is the last."""
    if n < 0:
        return F.date_sub(F.next_day(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), weekday), 7)
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))


#: Named days as (month, day) or (month, weekday, n).
NAMED_DAYS = {
    "new_year": (1, 1),
    "valentines": (2, 14),
    "independence_day": (7, 4),
    "halloween": (10, 31),
    "christmas": (12, 25),
    "memorial_day": (5, "Mon", -1),
    "labor_day": (9, "Mon", 1),
    "thanksgiving": (11, "Thu", 4),
}


def named_day(name: str, reference: Column) -> Column:
    """The most recent occurrence on or before the reference."""

    def of(year: Column) -> Column:
        rule = NAMED_DAYS[name]
        return F.make_date(year, F.lit(rule[0]), F.lit(rule[1])) if len(rule) == 2 else nth_weekday(year, rule[0], rule[1], rule[2])

    now = of(F.year(reference))
    return F.when(now <= reference, now).otherwise(of(F.year(reference) - 1))


def duration(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """Least and greatest days from the earlier interval to the later; overlap counts as 0."""
    swap = b_start < a_start
    e_start, e_end = F.when(swap, b_start).otherwise(a_start), F.when(swap, b_end).otherwise(a_end)
    l_start, l_end = F.when(swap, a_start).otherwise(b_start), F.when(swap, a_end).otherwise(b_end)
    least = F.greatest(F.lit(0), F.datediff(l_start, F.date_sub(e_end, 1)))
    return least, F.greatest(least, F.datediff(F.date_sub(l_end, 1), e_start))


def status(event: Column, reference: Column) -> Column:
    """now, past or future; undated facts are now."""
    return F.when(event.isNull() | (event == reference), F.lit("now")).when(event < reference, F.lit("past")).otherwise(F.lit("future"))


def relation(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Where a lies against b."""
    return F.when(a_end <= b_start, F.lit("before")).when(a_start >= b_end, F.lit("after")).when((a_start >= b_start) & (a_end <= b_end), F.lit("within")).otherwise(F.lit("overlaps"))


def numbered(facts: DataFrame, key: str, date: str, ident: str) -> DataFrame:
    """Facts numbered by date within a key, undated last."""
    order = Window.partitionBy(key).orderBy(F.col(date).asc_nulls_last(), ident)
    return facts.withColumn("position", F.row_number().over(order).cast("long"))


def first_after(facts: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """The first fact of each key strictly after its anchor (key, anchor)."""
    after = facts.join(anchors, key).where("ts > anchor")
    return after.groupBy(key).agg(F.min_by("id", F.struct("ts", "id")).alias("id"), F.min("ts").alias("ts"))


def as_of(history: DataFrame, times: DataFrame, key: list[str]) -> DataFrame:
    """The value of each key at each of its times: that of the latest row not after it.

    History and times are sorted together once, and each time takes the last value before it, so no time meets all rows
    of its key.
    """
    marks = history.select(*key, F.col("recorded_at").alias("moment"), F.lit(0).alias("kind"), "id", F.struct("value").alias("held"))
    asked = times.select(*key, F.col("at").alias("moment"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(marks.schema["held"].dataType).alias("held"))
    order = Window.partitionBy(*key).orderBy("moment", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("held", ignorenulls=True).over(order)
    return marks.unionByName(asked).withColumn("last", last).where("kind = 1 and last is not null").select(*key, F.col("moment").alias("at"), "last.value")


def validity(history: DataFrame, key: list[str]) -> DataFrame:
    """Each history row's [valid_from, valid_until), the latest open."""
    later = Window.partitionBy(*key).orderBy("recorded_at", "id")
    return history.withColumn("valid_from", F.col("recorded_at")).withColumn("valid_until", F.lead("recorded_at").over(later))


def gaps(facts: DataFrame, key: list[str]) -> DataFrame:
    """Days since the fact before it of the same key."""
    order = Window.partitionBy(*key).orderBy("ts", "id")
    return facts.withColumn("gap_days", F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(order))).cast("long"))
