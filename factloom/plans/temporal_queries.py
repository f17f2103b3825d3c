"""Calendar, duration, order and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import temporal
from factloom.plans.registry import register
from factloom.sources import driver_tables as src

HISTORY = f"{src.ASSERTIONS}, history AS (SELECT subject AS entity_id, rel_type AS attribute, ts AS recorded_at, id, value FROM assertions)"


def history(spark, folder):
    return src.assertions(spark, folder).select(F.col("subject").alias("entity_id"), F.col("rel_type").alias("attribute"), F.col("ts").alias("recorded_at"), "id", "value")


@register(
    "calendar_window",
    """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + 7 AS DATE) AS week_end,
        CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS last_month, CAST(date_trunc('month', o_orderdate) AS DATE) AS last_month_end,
        CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR AS DATE) AS next_year,
        CAST(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT) AS DATE) AS sunday FROM orders""",
)
def calendar_window(spark, folder):
    day = F.to_date("o_orderdate")
    week, month, year = temporal.calendar_window(day, "week", 0), temporal.calendar_window(day, "month", -1), temporal.calendar_window(day, "year", 1)
    columns = [week[0].alias("week_start"), week[1].alias("week_end"), month[0].alias("last_month"), month[1].alias("last_month_end"), year[0].alias("next_year"), temporal.week_start(day, 6).alias("sunday")]
    return src.table(spark, folder, "orders").select("o_orderkey", *columns)


NTH = "CAST(make_date({y}, {m}, 1) + CAST((({d} - isodow(make_date({y}, {m}, 1)) + 7) % 7 + 7 * ({n} - 1)) AS INT) AS DATE)"
LAST_MAY = "CAST(make_date({y}, 5, 31) - CAST((isodow(make_date({y}, 5, 31)) - 1) AS INT) AS DATE)"


def _recent(rule: str) -> str:
    now, before = rule.format(y="y"), rule.format(y="(y - 1)")
    return f"CASE WHEN {now} <= d THEN {now} ELSE {before} END"


@register(
    "named_event_dates",
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders)
    SELECT o_orderkey, {_recent("make_date({y}, 12, 25)")} AS christmas, {_recent(NTH.format(y="{y}", m=11, d=4, n=4))} AS thanksgiving,
        {_recent(NTH.format(y="{y}", m=9, d=1, n=1))} AS labor_day, {_recent(LAST_MAY)} AS memorial_day FROM o""",
)
def named_event_dates(spark, folder):
    day = F.to_date("o_orderdate")
    return src.table(spark, folder, "orders").select("o_orderkey", *[temporal.named_day(n, day).alias(n) for n in ("christmas", "thanksgiving", "labor_day", "memorial_day")])


@register(
    "duration_pairs",
    """WITH p AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) + 1 AS b FROM lineitem GROUP BY 1),
        q AS (SELECT p.*, CAST(o_orderdate AS DATE) AS c, CAST(o_orderdate AS DATE) + 1 AS e FROM p JOIN orders ON o_orderkey = l_orderkey),
        s AS (SELECT l_orderkey, CASE WHEN c <= a THEN c ELSE a END AS e0, CASE WHEN c <= a THEN e ELSE b END AS e1, CASE WHEN c <= a THEN a ELSE c END AS l0, CASE WHEN c <= a THEN b ELSE e END AS l1 FROM q),
        t AS (SELECT l_orderkey, greatest(0, l0 - (e1 - 1)) AS least_days, (l1 - 1) - e0 AS span FROM s)
    SELECT l_orderkey, CAST(least_days AS BIGINT) AS least_days, CAST(greatest(least_days, span) AS BIGINT) AS most_days FROM t""",
)
def duration_pairs(spark, folder):
    shipped = src.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.date_add(F.to_date(F.max("l_shipdate")), 1).alias("b"))
    ordered = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("c"))
    least, most = temporal.duration(F.col("c"), F.date_add("c", 1), F.col("a"), F.col("b"))
    return shipped.join(ordered, "l_orderkey").select("l_orderkey", least.cast("long").alias("least_days"), most.cast("long").alias("most_days"))


@register(
    "temporal_status",
    """SELECT o_orderstatus, CASE WHEN d IS NULL OR d = DATE '1995-06-17' THEN 'now' WHEN d < DATE '1995-06-17' THEN 'past' ELSE 'future' END AS status, count(*) AS n
    FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders) GROUP BY ALL""",
)
def temporal_status(spark, folder):
    day = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
    rows = src.table(spark, folder, "orders").select("o_orderstatus", temporal.status(day, F.lit("1995-06-17").cast("date")).alias("status"))
    return rows.groupBy("o_orderstatus", "status").agg(F.count("*").alias("n"))


@register(
    "event_order_numbered",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY d NULLS LAST, o_orderkey) AS position
    FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders)""",
)
def event_order_numbered(spark, folder):
    rows = src.table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("d"))
    return temporal.numbered(rows, "o_custkey", "d", "o_orderkey").select("o_custkey", "o_orderkey", "position")


@register(
    "first_after_anchor",
    f"""WITH {src.ASSERTIONS}, a AS (SELECT subject, min(ts) AS anchor FROM assertions WHERE rel_type = 'purchase' GROUP BY 1)
    SELECT subject, arg_min(id, (ts, id)) AS id, min(ts) AS ts FROM assertions JOIN a USING (subject) WHERE ts > anchor GROUP BY subject""",
)
def first_after_anchor(spark, folder):
    log = src.assertions(spark, folder)
    return temporal.first_after(log, log.where("rel_type = 'purchase'").groupBy("subject").agg(F.min("ts").alias("anchor")), "subject")


@register(
    "interval_relation",
    """WITH s AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS a0, CAST(max(l_shipdate) AS DATE) + 1 AS a1 FROM lineitem GROUP BY 1),
        m AS (SELECT s.*, CAST(date_trunc('month', o_orderdate) AS DATE) AS b0, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS b1 FROM s JOIN orders ON o_orderkey = l_orderkey)
    SELECT CASE WHEN a1 <= b0 THEN 'before' WHEN a0 >= b1 THEN 'after' WHEN a0 >= b0 AND a1 <= b1 THEN 'within' ELSE 'overlaps' END AS relation, count(*) AS n FROM m GROUP BY 1""",
)
def interval_relation(spark, folder):
    shipped = src.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("a0"), F.date_add(F.to_date(F.max("l_shipdate")), 1).alias("a1"))
    b0, b1 = temporal.calendar_window(F.to_date("o_orderdate"), "month", 0)
    months = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), b0.alias("b0"), b1.alias("b1"))
    named = temporal.relation(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    return shipped.join(months, "l_orderkey").groupBy(named.alias("relation")).agg(F.count("*").alias("n"))


@register(
    "asof_attribute",
    f"""WITH {HISTORY}, t AS (SELECT DISTINCT entity_id, attribute, unnest([TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-20']) AS "at" FROM history)
    SELECT entity_id, attribute, "at", arg_max(value, (recorded_at, id)) AS value FROM t JOIN history USING (entity_id, attribute) WHERE recorded_at <= "at" GROUP BY ALL""",
)
def asof_attribute(spark, folder):
    log = history(spark, folder)
    moments = F.array(*[F.lit(x).cast("timestamp_ntz") for x in ("2024-01-08", "2024-01-20")])
    times = log.select("entity_id", "attribute").distinct().withColumn("at", F.explode(moments))
    return temporal.as_of(log, times, ["entity_id", "attribute"])


@register(
    "validity_from_history",
    f"WITH {HISTORY} SELECT id, entity_id, attribute, recorded_at AS valid_from, lead(recorded_at) OVER (PARTITION BY entity_id, attribute ORDER BY recorded_at, id) AS valid_until FROM history",
)
def validity_from_history(spark, folder):
    return temporal.validity(history(spark, folder), ["entity_id", "attribute"]).select("id", "entity_id", "attribute", "valid_from", "valid_until")


@register("tense_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderkey % 10 = 0 AND o_orderstatus = 'O') OR (o_orderkey % 10 <> 0 AND CAST(o_orderdate AS DATE) > DATE '1995-06-17')")
def tense_filter(spark, folder):
    """Future orders and undated open ones."""
    day = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
    tense = temporal.status(day, F.lit("1995-06-17").cast("date"))
    rows = src.table(spark, folder, "orders").withColumn("day", day)
    return rows.where((tense == "future") | (F.col("day").isNull() & (F.col("o_orderstatus") == "O"))).select("o_orderkey", "o_orderstatus")


@register("gap_between_events", f"WITH {src.ASSERTIONS} SELECT id, subject, CAST(CAST(ts AS DATE) - CAST(lag(ts) OVER (PARTITION BY subject ORDER BY ts, id) AS DATE) AS BIGINT) AS gap_days FROM assertions")
def gap_between_events(spark, folder):
    return temporal.gaps(src.assertions(spark, folder), ["subject"]).select("id", "subject", "gap_days")
