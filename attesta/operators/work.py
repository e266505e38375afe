"""Work matrix, checkpoints, run progress and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import is_blank, unit_key
from .ordered import first_rows, running_total

MONEY = "decimal(20,8)"


def plan_units(
    targets: DataFrame,
    dimensions: Sequence[tuple[str, Column | None]],
    planned: DataFrame | None = None,
) -> DataFrame:
    """Targets by dimensions, less what does not apply.

    A dimension is a name and, if it is not for every target, a predicate over target
    columns. The few dimensions are a column of each target row, so nothing is joined.
    ``planned`` restricts the plan to the unit keys of a saved run.
    """
    applies = [
        F.when(F.lit(True) if test is None else test, F.lit(name)) for name, test in dimensions
    ]
    matrix = targets.select(
        F.col("key").alias("target"),
        F.col("label").alias("target_label"),
        F.explode(F.array_compact(F.array(*applies))).alias("dimension"),
    ).withColumn("unit_key", unit_key(F.col("target"), F.col("dimension")))
    return matrix if planned is None else matrix.join(planned, "unit_key", "left_semi")


def latest_units(units: DataFrame) -> DataFrame:
    """The last write of every unit wins; a repeated delivery changes nothing."""
    latest = first_rows(units, ["unit_key"], [F.col("saved_at").desc(), F.col("seq").desc()], 1)
    return latest.drop("_rank")


def pending_units(plan: DataFrame, units: DataFrame) -> DataFrame:
    """Planned units without a successful checkpoint; a failed one is work to redo."""
    done = latest_units(units).filter(is_blank(F.col("error"))).select("unit_key")
    return plan.join(done, "unit_key", "left_anti")


def run_progress(units: DataFrame) -> DataFrame:
    """Units done and money spent per run, from the last checkpoint of each of its units."""
    last = first_rows(units, ["run_id", "unit_key"], [F.col("saved_at").desc(), F.col("seq").desc()], 1)
    return last.groupBy("run_id").agg(
        F.count("*").alias("done"),
        F.count_if(is_blank(F.col("error"))).alias("succeeded"),
        F.round(F.coalesce(F.sum(F.col("cost_usd").cast(MONEY)), F.lit(0)).cast("double"), 4).alias("cost_usd"),
    )


def estimate(plan: DataFrame, verify: bool) -> DataFrame:
    """Expected cost band of a plan, one row."""
    agents = F.col("agents")
    base = agents * F.lit(fixed.COST_PER_AGENT_USD)
    low = base + agents * fixed.ESTIMATE_VERIFY_LOW if verify else base
    high = base * fixed.ESTIMATE_HIGH_FACTOR
    high = high + agents * fixed.ESTIMATE_VERIFY_HIGH if verify else high
    return plan.agg(
        F.count("*").alias("agents"),
        F.count_distinct("target").alias("targets"),
        F.count_distinct("dimension").alias("dimensions"),
    ).select(
        "*",
        F.lit(verify).alias("verify"),
        F.round(low, 2).alias("est_cost_low_usd"),
        F.round(high, 2).alias("est_cost_high_usd"),
    )


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with their cost; a model without a price takes the fallback price.

    Spark broadcasts the price table where its size allows. Money is decimal, so that sums
    do not depend on their order.
    """
    fallback_in, fallback_out = fixed.FALLBACK_PRICE
    rate_in = F.coalesce(F.col("price_in"), F.lit(fallback_in).cast("decimal(10,2)"))
    rate_out = F.coalesce(F.col("price_out"), F.lit(fallback_out).cast("decimal(10,2)"))
    micro = F.col("prompt_tokens").cast("decimal(18,0)") * rate_in + F.col("completion_tokens").cast(
        "decimal(18,0)"
    ) * rate_out
    return (
        calls.join(prices, "model", "left")
        .withColumn("cost_usd", (micro / F.lit(1_000_000).cast("decimal(8,0)")).cast(MONEY))
        .drop("price_in", "price_out")
    )


def ledger(priced: DataFrame) -> DataFrame:
    """Calls, tokens and cost per model, and in total (model null)."""
    return priced.rollup("model").agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum("cost_usd").cast("double"), 4).alias("cost_usd"),
    )


def budget_cutoff(priced: DataFrame, limit_usd: float) -> DataFrame:
    """Running spend per run; calls allowed, the one that crosses the ceiling, and those after it."""
    limit = F.lit(str(limit_usd)).cast(MONEY)
    spent = running_total(priced, ["run_id"], ["call_id"], F.col("cost_usd"), "running_usd")
    before = F.col("running_usd") - F.col("cost_usd")
    outcome = (
        F.when(before >= limit, "blocked").when(F.col("running_usd") >= limit, "crossing").otherwise("allowed")
    )
    return spent.withColumn("outcome", outcome)


def deadline_cut(log: DataFrame, finished: str, deadline: Column) -> DataFrame:
    """Keep every row; what had not finished by the deadline is labelled, not lost."""
    done = F.coalesce(F.col(finished) <= deadline, F.lit(False))
    return log.withColumn("completed", done).withColumn(
        "error", F.when(done, F.col("error")).otherwise(F.lit("cancelled: run deadline"))
    )
