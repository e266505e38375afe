"""Result tables of streaming queries: rows appended as they close, or running values by key in levels."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_folder
from .levels import Levels, newest


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table_schema(rows: DataFrame) -> StructType:
    """The columns of a batch and the number of the batch that wrote them."""
    return StructType([*rows.schema.fields, StructField("batch_id", LongType())])


def run_to_end(stream: DataFrame, mode: str, folder: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process all that has arrived, then stop; a later call goes on from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def append_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Append finished rows to Parquet, then read them."""
    path = f"{folder}/rows"
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def keyed_to_end(stream: DataFrame, keys: list[str], folder: str, live: Column | None = None) -> DataFrame:
    """Keep the running value of every key, then read the newest."""
    table = Levels(stream.sparkSession, f"{folder}/table", table_schema(stream), newest(keys), live)
    run_to_end(stream, "update", folder, table.add)
    return table.read().drop("batch_id")


def merged_to_end(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], folder: str, live: Column | None = None
) -> DataFrame:
    """Each batch is reduced to ``partial`` rows and merged into the table: the table is the state, none is held."""
    table = Levels(stream.sparkSession, f"{folder}/table", table_schema(partial(stream)), merge, live)
    run_to_end(stream, "append", folder, lambda batch, n: table.add(partial(batch), n))
    return table.read().drop("batch_id")
