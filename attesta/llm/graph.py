"""Connected components of a large edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/attesta-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node that it reaches.

    Alternates two steps on stars until nothing changes: every node joins its larger neighbours to its
    smallest one, then its smaller neighbours and itself to the smallest. Each step is a grouped minimum,
    which combines in the map tasks, and a join that the adaptive skew join can split. Nodes must not be null.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # A node that is its own minimum keeps its larger neighbours as they are.
        moved = both.where("v > u").join(least.where("m < u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = both.where("v > u").join(least.where("m < u"), "u", "left_anti").select(F.col("v").alias("u"), F.col("u").alias("v"))
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        now = stored(moved.union(kept).union(own).distinct())
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        lower = now.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(lower.union(least.select("u", F.col("m").alias("v"))).distinct())
