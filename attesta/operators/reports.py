"""Web-analytics reports over an event log: sessions, metrics, named recipes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.dates import resolve_window

CONVERSIONS = ("purchase", "signup")
ENGAGED_SECONDS = 10
_MICROS = 1_000_000


def sessions(events: DataFrame, dims: Sequence[str], gap_seconds: int = 30 * 60) -> DataFrame:
    """Events ``event_id, ts, user_id, event_type`` and dimension columns to one row per session.

    A session ends after ``gap_seconds`` of silence and takes the dimension values of its
    first event. Two events of a user in one time slot as long as the gap are always of
    one session, so events are first reduced to slots, within the task; what is shuffled
    and put in order per user is bounded by the time covered, not by the user's activity.
    """
    gap = gap_seconds * _MICROS
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = (
        events.withColumn("_us", us)
        .withColumn("_slot", F.floor(F.col("_us") / gap))
        .groupBy("user_id", "_slot")
        .agg(
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == "view").alias("views"),
            F.count_if(F.col("event_type").isin(*CONVERSIONS)).alias("conversions"),
            F.min_by(F.struct(*dims), F.struct("_us", "event_id")).alias("_dims"),
        )
    )
    user = Window.partitionBy("user_id").orderBy("_slot")
    apart = F.col("_first") - F.lag("_last").over(user) > gap
    numbered = slots.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "session_no", F.sum("_new").over(user)
    )
    duration = F.col("_end") - F.col("_start")
    return (
        numbered.groupBy("user_id", "session_no")
        .agg(
            F.min("_first").alias("_start"),
            F.max("_last").alias("_end"),
            *[F.sum(c).alias(c) for c in ("events", "views", "conversions")],
            F.min_by("_dims", "_slot").alias("_dims"),
        )
        .select(
            "user_id",
            "session_no",
            F.timestamp_micros("_start").alias("started_at"),
            duration.alias("duration_us"),
            "events",
            "views",
            "conversions",
            ((duration >= ENGAGED_SECONDS * _MICROS) | (F.col("views") >= 2) | (F.col("conversions") >= 1)).alias("engaged"),
            (F.col("session_no") == 1).alias("is_new"),
            F.date_format(F.timestamp_micros("_start"), "yyyy-MM-dd").alias("date"),
            "_dims.*",
        )
    )


def _rate(part: Column) -> Column:
    return F.round(part / F.count("*"), 4)


def session_metrics() -> dict[str, Column]:
    """Metric name to aggregate over session rows; callers may add their own."""
    engaged = F.count_if("engaged")
    return {
        "activeUsers": F.count_distinct("user_id"),
        "sessions": F.count("*"),
        "engagedSessions": engaged,
        "engagementRate": _rate(engaged),
        "bounceRate": F.round(1 - engaged / F.count("*"), 4),
        "averageSessionDuration": F.round(F.sum("duration_us") / F.count("*") / _MICROS, 4),
        "userEngagementDuration": F.round(F.sum(F.when(F.col("engaged"), F.col("duration_us")).otherwise(0)) / _MICROS, 4),
        "newUsers": F.count_if("is_new"),
        "screenPageViews": F.sum("views"),
        "conversions": F.sum("conversions"),
    }


def event_metrics() -> dict[str, Column]:
    """Metric name to aggregate over event rows."""
    return {"eventCount": F.count("*"), "activeUsers": F.count_distinct("user_id")}


def report(
    facts: DataFrame,
    dims: Sequence[str],
    metrics: Sequence[str],
    order_by: str | None = None,
    limit: int | None = None,
    keep_not_set: bool = False,
    registry: dict[str, Column] | None = None,
) -> DataFrame:
    """Metrics by dimensions, best first (by date: oldest first); rows unknown in every dimension go."""
    dims = list(dict.fromkeys(dims))
    if len(dims) > fixed.MAX_DIMENSIONS:
        raise ValueError(f"at most {fixed.MAX_DIMENSIONS} dimensions, got {len(dims)}: {', '.join(dims)}")
    registry = registry or session_metrics()
    rows = facts if keep_not_set else drop_all_not_set(facts, dims)
    out = rows.groupBy(*dims).agg(*[registry[m].alias(m) for m in metrics])
    if order_by is not None:
        first = F.col(order_by).asc() if order_by in dims else F.col(order_by).desc()
        out = out.orderBy(first, *dims)
    return out if limit is None else out.limit(limit)


def drop_all_not_set(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows with at least one known dimension."""
    unknown = F.lit(True)
    for name in dims:
        unknown = unknown & (F.col(name) == fixed.NOT_SET)
    return rows.filter(~F.coalesce(unknown, F.lit(False)))


def run_recipe(name: str, facts: DataFrame, limit: int | None = None, **options) -> DataFrame:
    """A named report; event reports take event rows, the others session rows."""
    dims, metrics, order_by = fixed.REPORT_RECIPES[name]
    registry = event_metrics() if "eventName" in dims else session_metrics()
    return report(facts, dims, metrics, order_by, limit, registry=registry, **options)


def report_totals(facts: DataFrame, metrics: Sequence[str], registry: dict[str, Column] | None = None) -> DataFrame:
    """Totals of the whole, not sums of rows: a user counts once."""
    registry = registry or session_metrics()
    return facts.agg(*[registry[m].alias(m) for m in metrics])


def trend_change(daily: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Change of a metric against the row before it; ``daily`` has one row per key and date."""
    past = F.lag(metric).over(Window.partitionBy(*by).orderBy("date"))
    return daily.withColumn("previous", past).withColumn("change", F.col(metric) - F.col("previous"))


# windows, filters, totals ---------------------------------------------------------------------


def write_days(events: DataFrame, path: str) -> None:
    """Events kept by the day of their ``ts``; a day's events are dealt over files of even size."""
    days = events.withColumn("day", F.to_date("ts"))
    days.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)


def in_window(facts: DataFrame, day: str, first, last) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included; on a table kept by day, only those are read."""
    return facts.filter(F.col(day).between(F.lit(first), F.lit(last)))


#: What a filter may ask of a dimension; each takes the lower-case column and the lower-case values asked for.
_TESTS = {
    "is": lambda c, values: c.isin(values),
    "contains": lambda c, values: _any(F.contains(c, F.lit(v)) for v in values),
    "begins": lambda c, values: _any(F.startswith(c, F.lit(v)) for v in values),
    "ends": lambda c, values: _any(F.endswith(c, F.lit(v)) for v in values),
    "matches": lambda c, values: _any(c.rlike(v) for v in values),
}


def _any(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests)


def matching(filters: Iterable[tuple[str, str, Sequence[str]]]) -> Column:
    """All of the filters (dimension, operator, values); any of a filter's values will do, and case does not matter.

    Operators are is, contains, begins, ends and matches, and the same after ``not ``. An unknown value matches none
    but the negated ones. Patterns are taken as they stand.
    """
    out = F.lit(True)
    for dimension, operator, values in filters:
        wanted = operator.removeprefix("not ")
        if wanted not in _TESTS or not values:
            raise ValueError(f"no filter {operator!r} with {len(values)} values")
        low = [str(v) if wanted == "matches" else str(v).lower() for v in values]
        holds = F.coalesce(_TESTS[wanted](F.lower(dimension), low), F.lit(False))
        out = out & (~holds if operator.startswith("not ") else holds)
    return out


def report_with_totals(
    facts: DataFrame, dims: Sequence[str], metrics: Sequence[str], registry: dict[str, Column] | None = None,
    filters: Iterable[tuple[str, str, Sequence[str]]] = (),
) -> DataFrame:
    """Metrics by dimensions and for the whole (``is_total``) in one pass; a user counts once in the total."""
    registry = registry or session_metrics()
    rows = drop_all_not_set(facts.filter(matching(filters)), dims)
    # Beside an empty grouping a dimension is null in the total; its own nulls keep their rows apart by the flag.
    grouped = rows.groupingSets([list(dims), []], *dims)
    return grouped.agg((F.grouping_id() != 0).alias("is_total"), *[registry[m].alias(m) for m in metrics])


def window_report(
    days: DataFrame, dims: Sequence[str], metrics: Sequence[str], window: tuple[str, str], as_of: date,
    filters: Iterable[tuple[str, str, Sequence[str]]] = (),
) -> DataFrame:
    """A report over the days that two tokens mean on the day ``as_of``, of a table written by ``write_days``.

    Sessions are those of the window's events; filters on the dimensions of sessions look at their first event.
    """
    events = in_window(days, "day", *resolve_window(*window, as_of))
    if set(metrics) <= set(event_metrics()):
        return report_with_totals(events, dims, metrics, event_metrics(), filters)
    named = list(dict.fromkeys([*dims, *(f[0] for f in filters)]))
    return report_with_totals(sessions(events, named), dims, metrics, filters=filters)
