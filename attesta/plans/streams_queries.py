"""Streams: the given tables read as file streams to their end, and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators import work
from ..streaming import live, tables
from . import graph_queries as gq
from . import sql
from . import tables as t

QUERIES: dict = {}
CHECKS: dict = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


def _events(spark, sf_dir):
    events = live.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    users = t.table(spark, sf_dir, "customer").join(t.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return events.join(users.select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("country")), "user_id")


@query(
    "stream_active_users",
    """
SELECT window_start, country, count(*) AS "activeUsers" FROM (
  SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS window_start, n_name AS country, user_id
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey, range(6) r(i))
GROUP BY ALL""",
)
def stream_active_users(spark, sf_dir):
    panes = live.active_user_panes(_events(spark, sf_dir), ["country"])
    kept = tables.keyed_to_end(panes, ["pane_start", "country", "user_id"], tables.new_folder(spark, "active-users"))
    return live.active_users(kept, ["country"])


_REALTIME = fixed.REPORT_RECIPES["realtime"][0]


@query(
    "report_realtime",
    """
WITH e AS (
  SELECT ts, user_id, n_name AS country, ['mobile', 'desktop', 'tablet'][1 + user_id % 3] AS "deviceCategory", event_type AS "unifiedScreenName"
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
), latest AS (SELECT time_bucket(INTERVAL 5 MINUTE, max(ts)) - INTERVAL 25 MINUTE AS start FROM e)
SELECT start AS window_start, country, "deviceCategory", "unifiedScreenName", count(DISTINCT user_id) AS "activeUsers"
FROM e, latest WHERE ts >= start GROUP BY ALL""",
)
def report_realtime(spark, sf_dir):
    """The recipe's three dimensions over the last half hour that the stream has seen."""
    device = F.get(F.array(*[F.lit(d) for d in ("mobile", "desktop", "tablet")]), (F.col("user_id") % 3).cast("int"))
    events = _events(spark, sf_dir).withColumns({"deviceCategory": device, "unifiedScreenName": F.col("event_type")})
    panes = live.active_user_panes(events, _REALTIME)
    kept = tables.keyed_to_end(panes, ["pane_start", *_REALTIME, "user_id"], tables.new_folder(spark, "realtime"))
    return live.realtime(kept, _REALTIME)


@query(
    "stream_events",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, n_name AS country, count(*) AS "eventCount"
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def stream_events(spark, sf_dir):
    counts = live.event_counts(_events(spark, sf_dir), ["event_type", "country"])
    return tables.keyed_to_end(counts, ["window_start", "event_type", "country"], tables.new_folder(spark, "event-counts"))


@query(
    "stream_sessions",
    """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM m),
s AS (SELECT user_id, no, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS closed_at, count(*) AS events, count(*) FILTER (WHERE event_type = 'view') AS views,
             count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS conversions FROM n GROUP BY user_id, no)
SELECT user_id, started_at, closed_at, events, views, conversions FROM s WHERE closed_at <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_sessions(spark, sf_dir):
    return tables.append_to_end(live.session_metrics(_events(spark, sf_dir).drop("country")), tables.new_folder(spark, "sessions"))


def _turns(spark, sf_dir):
    return live.file_stream(spark, f"{sf_dir}/conversations.parquet")


@query(
    "stream_units",
    "SELECT 'c' || conv_id || '::' || role AS unit_key, CAST(to_timestamp(1700000000 + turn * 60) AS TIMESTAMP) AS saved_at, length(text) AS chars FROM conversations",
)
def stream_units(spark, sf_dir):
    """Every checkpoint is delivered twice and kept once."""
    units = _turns(spark, sf_dir).select(
        F.concat_ws("::", F.concat(F.lit("c"), "conv_id"), "role").alias("unit_key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("saved_at"),
        F.length("text").cast("long").alias("chars"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"),
    )
    return tables.append_to_end(live.unit_arrivals(units).drop("delivery"), tables.new_folder(spark, "units"))


@query(
    "stream_progress",
    """
WITH e AS (SELECT conv_id % 10 AS run_id, conv_id * 1000 + turn AS seq, turn, length(text) AS n,
                  CASE turn % 4 WHEN 0 THEN 'research' WHEN 2 THEN 'urls' WHEN 3 THEN 'verify' END AS stage FROM conversations)
SELECT run_id, last(stage ORDER BY seq) FILTER (WHERE stage IS NOT NULL) AS stage, max(turn) AS done, max(turn + 5) AS total, max(n)::DOUBLE AS cost_usd FROM e GROUP BY run_id""",
)
def stream_progress(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("plan", "unit", "merged", "urls")])
    events = _turns(spark, sf_dir).select(
        (F.col("conv_id") % 10).alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.get(names, (F.col("turn") % 4).cast("int")).alias("event"), F.col("turn").alias("done"), (F.col("turn") + 5).alias("total"),
        F.length("text").cast("double").alias("cost_usd"),
    )
    return live.run_state(events, tables.new_folder(spark, "progress"))


@query(
    "stream_budget",
    sql.with_ctes(t.CALLS_SQL)
    + "SELECT run_id, round(CAST(sum(cost_e8) AS DOUBLE) / 1e8, 8) AS spent_usd FROM priced GROUP BY run_id HAVING sum(cost_e8) >= 5000000",
)
def stream_budget(spark, sf_dir):
    models = F.array(F.lit("moonshotai/kimi-k2.6"), F.lit("qwen/qwen3.8-max"), F.lit("unlisted/model"))
    calls = _turns(spark, sf_dir).select(
        (F.col("conv_id") % 10).alias("run_id"), F.get(models, (F.col("conv_id") % 3).cast("int")).alias("model"),
        (F.length("text").cast("long") * 10).alias("prompt_tokens"), (F.length("text").cast("long") * 5).alias("completion_tokens"),
    )
    alerts = live.budget_alerts(work.price_calls(calls, t.prices(spark)), F.lit("0.05").cast("decimal(20,8)"), tables.new_folder(spark, "budget"))
    return alerts.withColumn("spent_usd", F.round(F.col("spent_usd").cast("double"), 8))


@query(
    "stream_graph_ingest",
    sql.with_ctes(gq._OBS)
    + "SELECT source_key, predicate, target_key, weight, confidence, first_seen, last_seen FROM rel WHERE predicate = 'supplies_part'",
)
def stream_graph_ingest(spark, sf_dir):
    lines = live.file_stream(spark, f"{sf_dir}/lineitem.parquet")
    return live.ingest_observations(gq.supply_observations(spark, sf_dir, lines), tables.new_folder(spark, "graph"))
