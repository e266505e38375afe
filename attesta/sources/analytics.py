"""Report payloads of an analytics service to wide rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_under

_VALUES = "array<struct<value:string>>"
_SCHEMA = (
    "struct<dimensionHeaders:array<struct<name:string>>,metricHeaders:array<struct<name:string>>,"
    f"rows:array<struct<dimensionValues:{_VALUES},metricValues:{_VALUES}>>,"
    f"totals:array<struct<metricValues:{_VALUES}>>,rowCount:bigint>"
)


def read_report_payload(raw: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Header names zipped with cell values; metrics become numbers of four places."""
    parsed = raw.withColumn("_r", F.from_json("payload", _SCHEMA)).drop("payload")
    rows = parsed.select(
        *[c for c in raw.columns if c != "payload"],
        F.col("_r.dimensionHeaders.name").alias("_dims"),
        F.col("_r.metricHeaders.name").alias("_metrics"),
        F.explode("_r.rows").alias("_row"),
    )
    dim_cells, metric_cells = F.col("_row.dimensionValues.value"), F.col("_row.metricValues.value")
    return rows.select(
        *[c for c in raw.columns if c != "payload"],
        *[cell_under(F.col("_dims"), dim_cells, d).alias(d) for d in dims],
        *[F.round(cell_under(F.col("_metrics"), metric_cells, m).try_cast("double"), 4).alias(m) for m in metrics],
    )


def read_report_totals(raw: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The totals of every payload, the rows it says there are and the rows it has.

    A payload without totals has null metrics; one without a row count has as many as it holds;
    one that is no JSON has no rows.
    """
    kept = [c for c in raw.columns if c != "payload"]
    parsed = raw.withColumn("_r", F.from_json("payload", _SCHEMA))
    cells = F.get("_r.totals.metricValues", F.lit(0))["value"]
    held = F.coalesce(F.size("_r.rows"), F.lit(0)).cast("long")
    return parsed.select(
        *kept,
        *[F.round(cell_under(F.col("_r.metricHeaders.name"), cells, m).try_cast("double"), 4).alias(m) for m in metrics],
        F.coalesce("_r.rowCount", held).alias("row_count"),
        held.alias("rows_read"),
    ).withColumn("complete", F.col("rows_read") >= F.col("row_count"))
