"""Small reference tables of fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed


PLATFORM_COLUMNS = ("platform", "company", "access", "ats", "token", "worker_gigs", "has_pay")


def dim_platforms(spark: SparkSession) -> DataFrame:
    types = [f"{c} {'boolean' if c in ('worker_gigs', 'has_pay') else 'string'}" for c in PLATFORM_COLUMNS]
    return spark.createDataFrame(list(fixed.PLATFORMS), ", ".join(types))


def dim_prices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(fixed.PRICE_PER_MTOK), "model string, price_in string, price_out string")
    return rows.select(
        "model", F.col("price_in").cast("decimal(10,2)"), F.col("price_out").cast("decimal(10,2)")
    )


def dim_reports(spark: SparkSession) -> DataFrame:
    rows = [
        (key, list(dims), list(metrics), order, key == "realtime")
        for key, (dims, metrics, order) in fixed.REPORT_RECIPES.items()
    ]
    return spark.createDataFrame(
        rows, "report string, dimensions array<string>, metrics array<string>, order_by string, realtime boolean"
    )


_SOURCE_TYPE = (
    "key string, country string, agency string, base_url string, protocol string, auth string, "
    "coverage array<string>, env_var string, signup_url string, docs_url string, formats array<string>, "
    "rate_limit string, gotchas string, verified boolean"
)


def dim_sources(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """A catalogue of statistics sources kept as JSON lines, with what each still needs.

    ``keys`` are the names of the credentials at hand.
    """
    open_access = F.col("auth").isin("none", "ua_required")
    ready = open_access | F.coalesce(F.col("env_var").isin(*keys) if keys else F.lit(False), F.lit(False))
    status = F.when(ready, "ready").otherwise(F.concat(F.lit("needs "), F.coalesce("env_var", F.lit("a key"))))
    return spark.read.schema(_SOURCE_TYPE).json(path).withColumn("status", status)
