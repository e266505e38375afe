"""Streaming transformations. Event time, watermarks and state only; sinks are elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import build_relations
from ..operators.reports import CONVERSIONS
from .levels import Levels
from .tables import merged_to_end, run_to_end, table_schema

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of a table as they arrive. A stream wants a folder or a pattern: the last letter is given as one, so that a single file will do."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def active_user_panes(events: DataFrame, dims: Sequence[str], pane: str = "5 minutes") -> DataFrame:
    """One running row per pane, dimension values and user: spread by user, each event in one pane."""
    return (
        events.withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", pane).alias("w"), *dims, "user_id")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("pane_start"), *dims, "user_id", "events")
    )


def active_users(panes: DataFrame, dims: Sequence[str], panes_per_window: int = 6, pane_seconds: int = 300) -> DataFrame:
    """Exact active users of every sliding window: a window is the union of its panes, and a user counts once in it."""
    back = F.sequence(F.lit(0), F.lit(panes_per_window - 1))
    starts = F.transform(back, lambda i: F.timestamp_seconds(F.unix_seconds("pane_start") - i * pane_seconds))
    users = panes.select(F.explode(starts).alias("window_start"), *dims, "user_id").distinct()
    return users.groupBy("window_start", *dims).agg(F.count("*").alias("activeUsers"))


def realtime(panes: DataFrame, dims: Sequence[str], panes_per_window: int = 6, pane_seconds: int = 300) -> DataFrame:
    """Active users of the newest window alone."""
    newest_pane = panes.select(F.max("pane_start")).scalar()
    start = F.timestamp_seconds(F.unix_seconds(newest_pane) - (panes_per_window - 1) * pane_seconds)
    last = panes.where(F.col("pane_start") >= start).select(start.alias("window_start"), *dims, "user_id").distinct()
    return last.groupBy("window_start", *dims).agg(F.count("*").alias("activeUsers"))


def event_counts(events: DataFrame, by: Sequence[str], width: str = "1 hour") -> DataFrame:
    """Events per tumbling window."""
    return (
        events.withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", width).alias("w"), *by)
        .agg(F.count("*").alias("eventCount"))
        .select(F.col("w.start").alias("window_start"), *by, "eventCount")
    )


def session_metrics(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions that the watermark has closed.

    With spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition a task merges its own events first.
    """
    return (
        events.withWatermark("ts", WATERMARK)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == "view").alias("views"),
            F.count_if(F.col("event_type").isin(*CONVERSIONS)).alias("conversions"),
        )
        .select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "events", "views", "conversions")
    )


def unit_arrivals(units: DataFrame, delay: str = "1 day") -> DataFrame:
    """Checkpoints as they land; a repeated delivery is dropped."""
    return units.withWatermark("saved_at", delay).dropDuplicatesWithinWatermark(["unit_key", "saved_at"])


def run_steps(events: DataFrame) -> DataFrame:
    """What a batch says of every run: its last stage with the number of that event, most units done, most money spent."""
    stage = (
        F.when(F.col("event") == "plan", "research")
        .when(F.col("event") == "merged", "urls")
        .when(F.col("event") == "urls", "verify")
        .when(F.col("event") == "verified", "synthesis")
        .when(F.col("event") == "done", "done")
    )
    staged = events.withColumn("_stage", stage)
    return merge_steps(staged.withColumn("_last", F.when(F.col("_stage").isNotNull(), F.struct("seq", F.col("_stage").alias("stage")))))


def merge_steps(rows: DataFrame) -> DataFrame:
    numbers = [F.max(c).alias(c) for c in ("done", "total", "cost_usd", "batch_id") if c in rows.columns]
    return rows.groupBy("run_id").agg(F.max("_last").alias("_last"), *numbers)


def run_state(events: DataFrame, folder: str, keep_finished: bool = True) -> DataFrame:
    """Where every run stands. No state is held between batches; finished runs may leave the table."""
    live = None if keep_finished else ~F.col("_last.stage").eqNullSafe(F.lit("done"))
    state = merged_to_end(events, run_steps, merge_steps, folder, live)
    return state.select("run_id", F.col("_last.stage").alias("stage"), "done", "total", "cost_usd")


def run_spend(priced: DataFrame) -> DataFrame:
    """Spend per run in a batch; calls are added up within the task before they meet."""
    return priced.groupBy("run_id").agg(F.sum("cost_usd").cast("decimal(30,8)").alias("spent_usd"))


def _merge_spend(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.sum("spent_usd").cast("decimal(30,8)").alias("spent_usd"), F.max("batch_id").alias("batch_id"))


def _merge_alerts(rows: DataFrame) -> DataFrame:
    """The first alert of every run."""
    return rows.groupBy("run_id").agg(F.min_by("spent_usd", "batch_id").alias("spent_usd"), F.min("batch_id").alias("batch_id"))


def budget_alerts(priced: DataFrame, limit: Column, folder: str) -> DataFrame:
    """One alert per run, written by the first batch that finds its spend at the ceiling."""
    spark, schema = priced.sparkSession, table_schema(run_spend(priced))
    spend, told = Levels(spark, f"{folder}/spend", schema, _merge_spend), Levels(spark, f"{folder}/alerts", schema, _merge_alerts)

    def each(batch: DataFrame, batch_id: int) -> None:
        spend.add(run_spend(batch), batch_id)
        # Only what this batch adds to can reach the ceiling now.
        now = spend.read().where((F.col("batch_id") == batch_id) & (F.col("spent_usd") >= limit))
        told.add(now.join(told.read().select("run_id"), "run_id", "left_anti").drop("batch_id"), batch_id)

    run_to_end(priced, "append", folder, each)
    return told.read().drop("batch_id")


def ingest_observations(observations: DataFrame, folder: str) -> DataFrame:
    """Append arriving observations to the log and fold them into the edges.

    A batch writes its observations under its number, and the edges it saw into the table of edges.
    """
    spark, log = observations.sparkSession, f"{folder}/observations"
    edges = Levels(spark, f"{folder}/edges", table_schema(build_relations(observations)), merge_edges)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        edges.add(build_relations(spark.read.schema(batch.schema).parquet(f"{log}/batch_id={batch_id}")), batch_id)

    run_to_end(observations, "append", folder, each)
    return edges.read().drop("batch_id")


def merge_edges(partial: DataFrame) -> DataFrame:
    """Edges of several batches as one table."""
    last = F.max(F.struct("last_seen", "batch_id", "confidence")).alias("_last")
    edges = partial.groupBy("source_key", "predicate", "target_key").agg(
        F.sum("weight").alias("weight"), F.min("first_seen").alias("first_seen"), last
    )
    return edges.select(
        "source_key", "predicate", "target_key", "weight", F.col("_last.confidence").alias("confidence"), "first_seen",
        F.col("_last.last_seen").alias("last_seen"), F.col("_last.batch_id").alias("batch_id"),
    )
