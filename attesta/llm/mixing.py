"""Mixing sources to target weights by thresholds on a hash.

Every source gets a share of all words by its weight, at most ``limit`` times its own words; what goes beyond is shared
out again. A source is taken whole as often as its target holds it; of its last part the documents are taken in the
order of a 56-bit hash until the budget is spent. Nothing is sorted: words are summed by source and the hash's first
eight bits, the bucket in which the budget ends is found, and only that bucket is looked at again, by the next eight
bits, with what the budget has left there. A source whose rest is ``GROUP_ROWS`` documents at most is settled at once: in
hash order each document that still fits is taken. Whatever lies in other buckets is decided by comparison alone.

Rows that agree on the whole hash (repeated rows) are told apart by a second hash, of a number that each stored row has.

Results: a null or empty text has size 0 and is taken with 0 words; null is a source like any other, the last one.
Repeated rows are documents each; the hash of a document is of its id, source and text, so reruns agree (of repeated
rows, in how many are taken). A source without words has target 0. An empty table gives no rows. ``mix`` returns the
named columns of the input and adds size, source_size, target, copies and taken, which replace columns of these names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.ordered import row_position

from .graph import stored
from .quality import words

WEIGHTS = (1, 2, 3)
LIMIT = 3
BUCKET_BITS = 8
LEVELS = 7  # of each of the two hashes
GROUP_ROWS = 4_096
HASH_BITS = BUCKET_BITS * LEVELS
KEPT, SOURCE, SIZE, HASH, ROW_HASH = "_attesta_kept", "_attesta_source", "_attesta_size", "_attesta_hash", "_attesta_row_hash"


def measured(docs: DataFrame, columns: list[str], source: str, text: str, doc_id: str) -> DataFrame:
    """The named columns as one struct, whatever their names, with size, source and the two hashes of every row, stored."""
    unsigned = 64 - HASH_BITS
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias(KEPT),
        F.col(source).alias(SOURCE),
        F.size(words(text)).cast("long").alias(SIZE),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(source), F.col(text)), unsigned).alias(HASH),
    )
    # Stored once, so that the numbers of rows stay as they are.
    return stored(rows.withColumn(ROW_HASH, F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), unsigned)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, n, target): ``sizes`` has a row per source. Sources are ordered by code point, null last.

    Sources above their limit are held at it and the rest is shared out again until none is above. The driver sees
    sums only.
    """
    none_last = sizes.withColumn("_none", F.col(SOURCE).isNull())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    found = stored(row_position(none_last, [], ["_none", SOURCE], "place").select(SOURCE, "source_size", "n", weight.alias("weight")))
    total = found.agg(F.sum("source_size")).first()[0] or 0
    most = limit * F.col("source_size")
    share = 0.0
    while True:
        held = F.col("weight") * share >= most
        free, fixed = found.agg(F.sum(F.when(~held, F.col("weight"))), F.sum(F.when(held, most))).first()
        # The share only grows, so a source once held stays held.
        again = (total - (fixed or 0)) / free if free else share
        if again <= share:
            break
        share = again
    return found.select(SOURCE, "source_size", "n", F.least(F.col("weight") * share, most.cast("double")).alias("target"))


def _bucket(level: int) -> Column:
    column, at = (HASH, level) if level < LEVELS else (ROW_HASH, level - LEVELS)
    return F.shiftright(column, HASH_BITS - BUCKET_BITS * (at + 1)).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1).cast("long"))


def _first_fit(group: pd.DataFrame) -> pd.DataFrame:
    """In hash order, each document that the budget still holds."""
    group = group.sort_values([HASH, ROW_HASH], kind="stable")
    left, more = int(group["budget"].iloc[0]) if len(group) else 0, []
    for size in group[SIZE]:
        fits = size <= left
        left -= size if fits else 0
        more.append(fits)
    return group.assign(more=more)


def _settled(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of sources with few rows left, with ``more``: the rows of a source come together, ``GROUP_ROWS`` at most."""
    few = rows.join(plan, rows[SOURCE].eqNullSafe(plan["_of"])).drop("_of")
    light = few.select(SOURCE, HASH, ROW_HASH, SIZE, "budget")
    schema = ", ".join(f"{n} {t}" for n, t in light.dtypes) + ", more boolean"
    chosen = light.groupBy(SOURCE).applyInPandas(_first_fit, schema)
    chosen = chosen.select(F.col(SOURCE).alias("_of"), F.col(HASH).alias("_hash"), F.col(ROW_HASH).alias("_row"), "more")
    same = F.col(SOURCE).eqNullSafe(F.col("_of")) & (F.col(HASH) == F.col("_hash")) & (F.col(ROW_HASH) == F.col("_row"))
    return few.drop("budget").join(chosen, same).drop("_of", "_hash", "_row")


def chosen(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``more``: whether the last, partial pass over the source takes the row.

    ``plan`` has _of (the source), n (its rows) and budget (words of the last pass).
    """
    columns, decided = rows.columns, []
    for level in range(2 * LEVELS + 1):
        last = level == 2 * LEVELS  # two rows with equal hashes throughout: settled together, whatever their number
        few = plan.where(F.lit(last) | (F.col("n") <= GROUP_ROWS)).select("_of", "budget")
        decided.append(_settled(rows, few).select(*columns, "more"))
        plan = plan.where(F.col("n") > GROUP_ROWS)
        if last or plan.isEmpty():
            break
        many = rows.withColumn("_bucket", _bucket(level)).join(plan, rows[SOURCE].eqNullSafe(plan["_of"]), "left_semi")
        held = many.groupBy(SOURCE, "_bucket").agg(F.sum(SIZE).alias("words"), F.count("*").alias("rows"))
        upto = Window.partitionBy(SOURCE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # 256 rows at most
        summed = held.withColumn("upto", F.sum("words").over(upto))
        crossing = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("_bucket", "rows", (F.col("budget") - F.col("upto") + F.col("words")).alias("left"))))
        ends = stored(
            summed.join(plan.select("_of", "budget"), summed[SOURCE].eqNullSafe(F.col("_of"))).groupBy("_of").agg(crossing.alias("at"))
            .select("_of", F.coalesce("at._bucket", F.lit(1 << BUCKET_BITS).cast("long")).alias("_end"), F.col("at.rows").alias("n"), F.col("at.left").alias("budget"))
        )
        placed = many.join(ends.select("_of", "_end"), many[SOURCE].eqNullSafe(ends["_of"]))
        decided.append(placed.where("_bucket <> _end").select(*columns, (F.col("_bucket") < F.col("_end")).alias("more")))
        rows = stored(placed.where("_bucket = _end").select(*columns))
        plan = ends.where("n IS NOT NULL").select("_of", "n", "budget")
    out = decided[0]
    for other in decided[1:]:
        out = out.unionByName(other)
    return out


def mix(
    docs: DataFrame, columns: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT,
    source: str = "source", text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """``columns`` (all by default) of every document with size, source_size, target, copies and taken."""
    added = ["size", "source_size", "target", "copies", "taken"]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in added]
    rows = measured(docs, columns, source, text, doc_id)
    sizes = rows.groupBy(SOURCE).agg(F.sum(SIZE).alias("source_size"), F.count("*").alias("n"))
    budget = F.round("target").cast("long")
    shares = stored(
        targets(sizes, weights, limit)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) div source_size")).otherwise(F.lit(0).cast("long")))
        .select(F.col(SOURCE).alias("_of"), "source_size", "n", "target", "whole", (budget - F.col("whole") * F.col("source_size")).alias("budget"))
    )
    # A source whose last pass takes nothing is done; the others are looked into.
    idle = shares.where("budget = 0").select("_of")
    none = rows.join(idle, rows[SOURCE].eqNullSafe(idle["_of"]), "left_semi").withColumn("more", F.lit(False))
    busy = chosen(rows, shares.where("budget > 0").select("_of", "n", "budget"))
    found = none.unionByName(busy).join(shares.select("_of", "source_size", "target", "whole"), F.col(SOURCE).eqNullSafe(F.col("_of")))
    copies = F.col("whole") + F.col("more").cast("long")
    return found.select(
        *[F.col(f"{KEPT}.`{c}`") for c in columns], F.col(SIZE).alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col(SIZE)).alias("taken")
    )
