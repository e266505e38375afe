"""Analytics reports: registered queries and their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators import reports as ops
from ..session import shared_folder
from ..sources.analytics import read_report_payload, read_report_totals
from . import sql
from . import tables as t

QUERIES: dict = {}
CHECKS: dict = {}

# dimension: values by (k or nation) modulo, as Spark and SQL expressions over n_nationkey, n_regionkey, k
_DIMS = {
    "country": ("n_name", None),
    "city": ("c_mktsegment", None),
    "language": ("n_regionkey", ("(not set)", "en-us", "hi-in", "de-de", "ar-eg")),
    "deviceCategory": ("k % 3", ("desktop", "mobile", "tablet")),
    "operatingSystem": ("k % 4", ("Windows", "Android", "iOS", "(not set)")),
    "operatingSystemVersion": ("k % 7", ("10", "11", "12", "13", "14", "15", "(not set)")),
    "mobileDeviceModel": ("k % 3", ("(not set)", "Pixel", "iPad")),
    "browser": ("k % 5", ("Chrome", "Firefox", "Safari", "Edge", "(not set)")),
    "pagePath": ("k % 10", tuple(f"/p/{i}" for i in range(10))),
    "pageTitle": ("k % 10", tuple(f"Page {i}" for i in range(10))),
    "landingPage": ("k % 10", tuple(f"/p/{i}" for i in range(10))),
    "sessionDefaultChannelGroup": ("k % 6", ("Direct", "Organic", "Paid", "Social", "Email", "(not set)")),
    "sessionSource": ("k % 4", ("google", "bing", "news", "(not set)")),
    "sessionMedium": ("k % 3", ("cpc", "organic", "(not set)")),
    "sessionCampaignName": ("k % 2", ("spring", "(not set)")),
}
SESSION_DIMS = tuple(_DIMS)


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the dimensions of their user and of their properties."""
    events = t.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    users = t.table(spark, sf_dir, "customer").join(
        t.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = events.join(users, events.user_id == users.c_custkey)

    def value(code: str, names):
        return F.expr(code) if names is None else F.get(F.array(*[F.lit(n) for n in names]), F.expr(f"int({code})"))

    return joined.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.col("event_type").alias("eventName"),
        *[value(*spec).alias(name) for name, spec in _DIMS.items()],
    )


def _sql_value(code: str, names) -> str:
    return code if names is None else "([" + ", ".join(f"'{n}'" for n in names) + f"])[1 + {code}]"


_EVENTS = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, event_type AS "eventName",
         {", ".join(f'{_sql_value(*spec)} AS "{name}"' for name, spec in _DIMS.items())}
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
  JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def _sessions_sql(gap: int) -> str:
    return f"""
marked AS (
  SELECT *, epoch_us(ts) AS us,
         CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {gap}::BIGINT * 1000000 THEN 0 ELSE 1 END AS fresh
  FROM ev
),
numbered AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM marked),
facts AS (
  SELECT *, duration_us >= 10000000 OR views >= 2 OR conversions >= 1 AS engaged, session_no = 1 AS is_new
  FROM (SELECT user_id, session_no, max(us) - min(us) AS duration_us, count(*) AS events, strftime(min(ts), '%Y-%m-%d') AS date,
               count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS conversions,
               {", ".join(f'first("{d}" ORDER BY ts, event_id) AS "{d}"' for d in SESSION_DIMS)}
        FROM numbered GROUP BY user_id, session_no)
)"""


_METRIC_SQL = {
    "activeUsers": "count(DISTINCT user_id)",
    "sessions": "count(*)",
    "engagedSessions": "count(*) FILTER (WHERE engaged)",
    "engagementRate": "round(count(*) FILTER (WHERE engaged) / count(*)::DOUBLE, 4)",
    "bounceRate": "round(1 - count(*) FILTER (WHERE engaged) / count(*)::DOUBLE, 4)",
    "averageSessionDuration": "round(CAST(sum(duration_us) AS DOUBLE) / count(*) / 1000000, 4)",
    "userEngagementDuration": "round(CAST(sum(CASE WHEN engaged THEN duration_us ELSE 0 END) AS DOUBLE) / 1000000, 4)",
    "newUsers": "count(*) FILTER (WHERE is_new)",
    "screenPageViews": "CAST(sum(views) AS BIGINT)",
    "conversions": "CAST(sum(conversions) AS BIGINT)",
    "eventCount": "count(*)",
}
_FACTS = {"session": (_EVENTS, _sessions_sql(1800)), "event": (_EVENTS, "facts AS (SELECT * FROM ev)")}


def _report_sql(name: str) -> str:
    dims, metrics, order = fixed.REPORT_RECIPES[name]
    kind = "event" if "eventName" in dims else "session"
    quoted = [f'"{d}"' for d in dims]
    known = " OR ".join(f"{d} <> '(not set)'" for d in quoted)
    head = f'"{order}"' + ("" if order in dims else " DESC")
    return sql.with_ctes(*_FACTS[kind]) + (
        f"SELECT {', '.join(quoted)}, {', '.join(f'{_METRIC_SQL[m]} AS {chr(34)}{m}{chr(34)}' for m in metrics)} "
        f"FROM facts WHERE {known} GROUP BY {', '.join(quoted)} ORDER BY {head}, {', '.join(quoted)}"
    )


def _register(name: str) -> None:
    dims, _, _ = fixed.REPORT_RECIPES[name]

    def run(spark, sf_dir):
        events = web_events(spark, sf_dir)
        if "eventName" in dims:
            return ops.run_recipe(name, events)
        wanted = [d for d in dims if d != "date"] or ["country"]
        return ops.run_recipe(name, ops.sessions(events, wanted))

    query("report_" + name.replace("-", "_"), _report_sql(name))(run)


for _name in fixed.REPORT_RECIPES:
    if _name != "realtime":
        _register(_name)


_TOTALS = ("activeUsers", "sessions", "engagedSessions", "engagementRate", "newUsers", "screenPageViews", "conversions")


@query(
    "report_totals",
    sql.with_ctes(*_FACTS["session"]) + "SELECT " + ", ".join(f'{_METRIC_SQL[m]} AS "{m}"' for m in _TOTALS) + " FROM facts",
)
def report_totals(spark, sf_dir):
    return ops.report_totals(ops.sessions(web_events(spark, sf_dir), ["country"]), _TOTALS)


@query(
    "sessions_half_day",
    sql.with_ctes(_EVENTS, _sessions_sql(12 * 3600))
    + """SELECT user_id, session_no, duration_us, events, views, conversions, engaged, is_new, date, "pagePath", "country" FROM facts""",
)
def sessions_half_day(spark, sf_dir):
    out = ops.sessions(web_events(spark, sf_dir), ["pagePath", "country"], gap_seconds=12 * 3600)
    return out.drop("started_at")


@query(
    "trend_change",
    sql.with_ctes(*_FACTS["session"])
    + """
SELECT *, sessions - previous AS change
FROM (SELECT date, country, sessions, lag(sessions) OVER (PARTITION BY country ORDER BY date) AS previous
      FROM (SELECT date, country, count(*) AS sessions FROM facts GROUP BY ALL))""",
)
def trend_change(spark, sf_dir):
    daily = ops.report(ops.sessions(web_events(spark, sf_dir), ["country"]), ["date", "country"], ["sessions"])
    return ops.trend_change(daily, ["country"], "sessions")


_days: dict[tuple[str, str], str] = {}


def event_days(spark, sf_dir):
    """The events of the given tables by day, stored once per application, and the last day among them."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _days:
        path = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
        ops.write_days(web_events(spark, sf_dir), path)
        _days[at] = path
    days = spark.read.parquet(_days[at])
    return days, days.agg(F.max("day")).first()[0]


def _window_sql(dims: str, metrics: tuple[str, ...], first: int, last: int, facts: str, where: str = "true") -> str:
    known = " AND ".join(f"{d} = '(not set)'" for d in dims.split(", "))
    return sql.with_ctes(
        _EVENTS.replace("ev AS (", "whole AS ("),
        f"ev AS (SELECT * FROM whole WHERE CAST(ts AS DATE) BETWEEN (SELECT max(CAST(ts AS DATE)) FROM whole) - {first} AND (SELECT max(CAST(ts AS DATE)) FROM whole) - {last})",
        facts,
    ) + f"""
SELECT {dims}, GROUPING({dims}) > 0 AS is_total, {", ".join(f'{_METRIC_SQL[m]} AS "{m}"' for m in metrics)}
FROM facts WHERE ({where}) AND NOT coalesce({known}, false) GROUP BY GROUPING SETS (({dims}), ())"""


_WEEK = ("activeUsers", "sessions", "engagedSessions", "screenPageViews")


@query("report_window", _window_sql('country, "deviceCategory"', _WEEK, 7, 1, _sessions_sql(1800)))
def report_window(spark, sf_dir):
    """The seven whole days before the last one, with totals in which a user counts once."""
    days, last = event_days(spark, sf_dir)
    return ops.window_report(days, ["country", "deviceCategory"], _WEEK, ("7dAgo", "yesterday"), last)


@query(
    "report_window_filtered",
    _window_sql(
        '"eventName", browser', ("eventCount", "activeUsers"), 27, 0, "facts AS (SELECT * FROM ev)",
        """lower(browser) IN ('chrome', 'safari') AND (starts_with(lower("eventName"), 'p') OR starts_with(lower("eventName"), 'v')) AND NOT contains(lower("pagePath"), '/p/3')""",
    ),
)
def report_window_filtered(spark, sf_dir):
    days, last = event_days(spark, sf_dir)
    filters = [("browser", "is", ["Chrome", "safari"]), ("eventName", "begins", ["P", "v"]), ("pagePath", "not contains", ["/p/3"])]
    return ops.window_report(days, ["eventName", "browser"], ("eventCount", "activeUsers"), ("28d", "today"), last, filters)


@query(
    "report_payload",
    """
SELECT event_id, event_type AS "eventName", strftime(ts, '%Y-%m-%d') AS date, round(value / 3, 4) AS "eventValue", 1.0::DOUBLE AS "eventCount"
FROM events""",
)
def report_payload(spark, sf_dir):
    def cells(*cols):
        return F.array(*[F.struct(c.cast("string").alias("value")) for c in cols])

    def heads(*names):
        return F.array(*[F.struct(F.lit(n).alias("name")) for n in names])

    row = F.struct(
        cells(F.date_format("ts", "yyyy-MM-dd"), F.col("event_type")).alias("dimensionValues"),
        cells(F.col("value") / 3, F.lit(1)).alias("metricValues"),
    )
    payload = F.to_json(
        F.struct(heads("date", "eventName").alias("dimensionHeaders"), heads("eventValue", "eventCount").alias("metricHeaders"), F.array(row).alias("rows"))
    )
    raw = t.table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return read_report_payload(raw, ["eventName", "date"], ["eventValue", "eventCount"])


@query(
    "report_payload_totals",
    """
SELECT event_id, round(value / 3, 4) AS "eventValue", 2.0::DOUBLE AS "eventCount", 1 + event_id % 2 AS row_count, 1::BIGINT AS rows_read, event_id % 2 = 0 AS complete
FROM events""",
)
def report_payload_totals(spark, sf_dir):
    """Payloads of one page each, of reports that have one or two rows."""
    cell = lambda c: F.struct(c.cast("string").alias("value"))
    heads = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("eventValue", "eventCount")])
    row = F.struct(F.array(cell(F.col("event_type"))).alias("dimensionValues"), F.array(cell(F.col("value")), cell(F.lit(1))).alias("metricValues"))
    total = F.struct(F.array(cell(F.col("value") / 3), cell(F.lit(2))).alias("metricValues"))
    payload = F.struct(
        heads.alias("metricHeaders"), F.array(row).alias("rows"), F.array(total).alias("totals"), (1 + F.col("event_id") % 2).alias("rowCount")
    )
    raw = t.table(spark, sf_dir, "events").select("event_id", F.to_json(payload).alias("payload"))
    return read_report_totals(raw, ["eventValue", "eventCount"])
