"""Order-dependent columns over groups of any size.

A plain window sends a whole group to one task. Here rows are dealt by range of (keys, order), so a large
group lies in several neighbouring parts and no task holds more than its range. Totals are taken within a
part, and what a group brings along from earlier parts is added after. Only a group that crosses the end of a
part brings anything, so the carried table has at most two rows for each part and may be broadcast.

The parts are written to the checkpoint folder before they are read twice: rows and carried values must come
from the same ranges. Keys may be null; a null is a key like any other. Rows that agree on keys and order lie
in one part, so ``order`` should tell rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage

PART = "_attesta_part"
VALUES_AT_ONCE = 10_000
RANGES = 1_024


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> tuple[DataFrame, WindowSpec]:
    """Rows with the number of their part, and the window of a group's rows in one part."""
    dealt = df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id())
    return dealt, Window.partitionBy(PART, *keys).orderBy(*order)


def _with_carried(rows: DataFrame, keys: Sequence[str], carried: dict[str, Column], over: WindowSpec) -> DataFrame:
    """Adds to the rows of a group what its earlier parts bring along, null where there are none.

    ``carried`` has an aggregate of a group's rows in one part for each new column; ``over`` says how those of the
    earlier parts are put together (all of them, added; or the last one).
    """
    ends = rows.groupBy(*keys, PART).agg(*[c.alias(n) for n, c in carried.items()])
    crossing = ends.withColumn("_attesta_parts", F.count("*").over(Window.partitionBy(*keys))).where("_attesta_parts > 1")
    before = crossing.select(
        F.struct(*[F.col(k) for k in keys]).alias("_attesta_group") if keys else F.lit(0).alias("_attesta_group"),
        F.col(PART).alias("_attesta_at"),
        *[over(n).alias(n) for n in carried],
    )
    same = [rows[PART] == F.col("_attesta_at"), *[rows[k].eqNullSafe(F.col("_attesta_group")[k]) for k in keys]]
    # Of each part at most the first and the last group cross its ends: two rows for each part, whatever the input.
    return rows.join(F.broadcast(before), reduce(Column.__and__, same), "left").drop("_attesta_at", "_attesta_group")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column]) -> DataFrame:
    """Adds a column for each of ``values``: its sum over the group's rows up to and with this one. Nulls add nothing."""
    dealt, window = _dealt(df, keys, order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    # A wide sum is narrowed again, so that a total has the type of its summands' sum.
    inside = dealt.select("*", *[F.sum(v).over(upto).alias(n) for n, v in values.items()], *[v.alias(f"_attesta_{n}") for n, v in values.items()])
    rows = cut_lineage(inside)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    names = {f"_attesta_carried_{n}": F.sum(f"_attesta_{n}") for n in values}
    out = _with_carried(rows, keys, names, lambda n: F.sum(n).over(earlier))
    for n in values:
        whole = F.coalesce(F.col(n) + F.col(f"_attesta_carried_{n}"), F.col(n), F.col(f"_attesta_carried_{n}"))
        out = out.withColumn(n, whole.cast(rows.schema[n].dataType))
    return out.drop(PART, *names, *[f"_attesta_{n}" for n in values])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over all rows of the group up to and with this one."""
    return running_totals(df, keys, order, {out: value})


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """1, 2, 3 … in ``order`` within the group; without keys, over all rows."""
    return running_totals(df, keys, order, {out: F.lit(1).cast("long")})


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The value on the row before this one in the group."""
    dealt, window = _dealt(df, keys, order)
    rows = cut_lineage(
        dealt.withColumns({out: F.lag(value).over(window), "_attesta_first": F.row_number().over(window) == 1})
    )
    place = F.struct(*[F.col(c) for c in order])
    earlier = Window.partitionBy(*keys).orderBy(PART)
    last = {"_attesta_last": F.max_by(F.struct(F.col(value).alias("v")), place)}
    found = _with_carried(rows, keys, last, lambda n: F.lag(n).over(earlier))
    return found.withColumn(out, F.when(F.col("_attesta_first"), F.col("_attesta_last.v")).otherwise(F.col(out))).drop(
        PART, "_attesta_first", "_attesta_last"
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows of every group; Spark cuts each task's groups to ``n`` before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= n)


def upper_median(
    df: DataFrame,
    keys: list[str],
    value: Column,
    out: str,
    counts: dict[str, Column] | None = None,
    lows: dict[str, Column] | None = None,
    highs: dict[str, Column] | None = None,
    values_at_once: int = VALUES_AT_ONCE,
) -> DataFrame:
    """The element at ``count div 2`` (from 0) of the sorted values of every group.

    Rows of equal value are reduced to one before they meet. A group of up to ``values_at_once`` different values is
    sorted; of a larger one the values are counted in ``RANGES`` ranges between its ends, and only the range that
    holds the middle is opened again, until it has few. Counts, minima and maxima of the group (dicts of name to
    column) come from the same pass; a null value counts only there.
    """
    counts, lows, highs = counts or {}, lows or {}, highs or {}
    equal = cut_lineage(
        df.groupBy(*keys, value.cast("double").alias("_value")).agg(
            F.count("*").alias("_n"),
            *[F.count_if(c).alias(n) for n, c in counts.items()],
            *[F.min(c).alias(n) for n, c in lows.items()],
            *[F.max(c).alias(n) for n, c in highs.items()],
        )
    )
    known = F.col("_value").isNotNull()
    groups = cut_lineage(
        equal.groupBy(*keys).agg(
            *[F.sum(n).alias(n) for n in counts],
            *[F.min(n).alias(n) for n in lows],
            *[F.max(n).alias(n) for n in highs],
            (F.floor(F.sum(F.when(known, F.col("_n"))) / 2) + 1).alias("_middle"),
            F.count_if(known).alias("_different"), F.min("_value").alias("_low"), F.max("_value").alias("_high"),
        )
    )
    values = equal.where(known).select(_group(keys), "_value", "_n")
    # What is still sought: a group, the rank in it, and the range that holds it with the number of values there.
    sought = groups.where("_different > 0").select(_group(keys), "_middle", "_different", "_low", "_high")
    found = None
    while True:
        few = values.join(sought.where(F.col("_different") <= values_at_once), "_attesta_group").where("_value BETWEEN _low AND _high")
        upto = Window.partitionBy("_attesta_group").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
        some = few.withColumn("_upto", F.sum("_n").over(upto)).where("_upto >= _middle").groupBy("_attesta_group").agg(F.min("_value").alias(out))
        found = some if found is None else found.unionByName(some)
        many = cut_lineage(sought.where(F.col("_different") > values_at_once))
        if many.isEmpty():
            break
        # Halves, as the distance of two doubles may be none.
        share = (F.col("_value") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        inside = values.join(many, "_attesta_group").where("_value BETWEEN _low AND _high")
        ranges = inside.groupBy("_attesta_group", "_middle", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("_range")).agg(
            F.sum("_n").alias("_n"), F.count("*").alias("_different"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
        )
        upto = Window.partitionBy("_attesta_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # RANGES rows
        ends = ranges.withColumn("_upto", F.sum("_n").over(upto)).where("_upto >= _middle")
        hit = F.min_by(F.struct("_middle", "_different", "_low", "_high", "_upto", "_n"), "_range").alias("h")
        sought = ends.groupBy("_attesta_group").agg(hit).select(
            "_attesta_group", (F.col("h._middle") - F.col("h._upto") + F.col("h._n")).alias("_middle"), "h._different", "h._low", "h._high"
        )
    return groups.withColumn("_attesta_group", _group(keys)).join(found, "_attesta_group", "left").drop(
        "_attesta_group", "_middle", "_different", "_low", "_high"
    )


def _group(keys: Sequence[str]) -> Column:
    """The keys as one value that joins also where keys are null: a struct is never null."""
    return F.struct(*[F.col(k) for k in keys]).alias("_attesta_group")
