"""Output tables as JSON lines, CSV and sectioned Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shape
from ..operators.ordered import first_rows

BOM = "﻿"


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; missing values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(
    df: DataFrame, path: str, delimiter: str = ",", include_provenance: bool = True, bom: bool = False, crlf: bool = True
) -> None:
    """Flat cells with a header per file, quoted where needed, quotes doubled.

    ``bom`` marks every file for spreadsheet programs; no file is gathered into one.
    """
    cells = shape.flat_cells(df, include_provenance)
    if bom:
        first = cells.columns[0]
        cells = cells.withColumnRenamed(first, BOM + first)
    (
        cells.write.mode("overwrite")
        .option("header", True)
        .option("sep", delimiter)
        .option("lineSep", "\r\n" if crlf else "\n")
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_json_report(
    rows: DataFrame, path: str, title: str, summary: DataFrame, meta: Mapping[str, str] | None = None, narrative: str = ""
) -> None:
    """Rows as JSON lines, beside a one-row envelope with title, time, meta, summary and narrative."""
    pairs = [F.lit(x) for kv in (meta or {}).items() for x in kv]
    envelope = summary.select(
        F.lit(title).alias("title"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("meta"),
        F.struct(*summary.columns).alias("summary"),
        F.lit(narrative).alias("narrative"),
    )
    write_jsonl(rows, f"{path}/rows")
    write_jsonl(envelope, f"{path}/report")


def write_sections(rows: DataFrame, path: str) -> None:
    """One folder per report section."""
    rows.write.mode("overwrite").partitionBy("section").parquet(path)


def append_units(units: DataFrame, path: str) -> None:
    """Append checkpoints; readers take the last write per unit, so writing twice is harmless."""
    units.write.mode("append").partitionBy("run_id").parquet(path)


def append_observations(observations: DataFrame, path: str) -> None:
    """Append to the observation log."""
    observations.write.mode("append").partitionBy("run_id").parquet(path)


def write_landed(values: DataFrame, path: str) -> None:
    """Values ``run_id, kind, body`` as lines, in a folder per run and kind."""
    values.select("body", "run_id", "kind").write.mode("append").partitionBy("run_id", "kind").text(path)


def compact_units(units: DataFrame, path: str) -> None:
    """The last checkpoint of every unit, as one generation; ``path`` must be another one than that of the units."""
    last = first_rows(units, ["run_id", "unit_key"], [F.col("saved_at").desc(), F.col("seq").desc()], 1).drop("_rank")
    last.write.mode("overwrite").partitionBy("run_id").parquet(path)
