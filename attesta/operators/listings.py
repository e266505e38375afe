"""Listings: filters, gig inference and pay comparison."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..session import stored
from ..sources.feeds import WHOLE_TEXT
from .ordered import row_position, upper_median


def has_pay() -> Column:
    return F.coalesce("pay_min", "pay_max").isNotNull()


def filter_pay(listings: DataFrame) -> DataFrame:
    return listings.filter(has_pay())


def flag_gigs(listings: DataFrame) -> DataFrame:
    """Pay by the hour, day or task marks a gig even where the platform does not."""
    by_unit = F.coalesce(F.col("pay_unit").isin(*fixed.GIG_PAY_UNITS), F.lit(False))
    return listings.withColumn("worker_gig", F.coalesce("worker_gig", F.lit(False)) | by_unit)


def filter_gigs(listings: DataFrame) -> DataFrame:
    return listings.filter("worker_gig")


def _any_of(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word.lower()))
    return found


def _in_place(location: Column, countries: Sequence[str]) -> Column:
    """Codes of up to three letters must stand alone: "in" is not Indonesia."""
    found = F.lit(False)
    for name in countries:
        name = name.lower()
        hit = location.rlike(rf"\b{re.escape(name)}\b") if len(name) <= 3 else F.contains(location, F.lit(name))
        found = found | hit
    return found


def filter_listings(
    listings: DataFrame,
    keywords: Sequence[str] = (),
    exclude: Sequence[str] = (),
    countries: Sequence[str] = (),
    remote_only: bool = False,
    pay_only: bool = False,
    gigs_only: bool = False,
) -> DataFrame:
    """Any keyword, no excluded word, any country, and the three switches. Descriptions are searched whole."""
    text = WHOLE_TEXT if WHOLE_TEXT in listings.columns else "description_excerpt"
    words = ("title", "department", text, "employment_type")
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in words]))
    place = F.lower(F.coalesce("location", F.lit("")))
    out = listings
    if keywords := [k for k in keywords if k]:
        out = out.filter(_any_of(blob, keywords))
    if exclude := [k for k in exclude if k]:
        out = out.filter(~_any_of(blob, exclude))
    if countries := [c for c in countries if c]:
        out = out.filter(_in_place(place, countries))
    if remote_only:
        out = out.filter(F.coalesce("remote", F.lit("")) != "")
    if pay_only:
        out = filter_pay(out)
    return filter_gigs(out) if gigs_only else out


def pay_summary(listings: DataFrame, by_currency: bool = True) -> DataFrame:
    """Per company: listings, those with pay, and the upper median of hourly rates."""
    keys = ["company", "pay_currency"] if by_currency else ["company"]
    hourly = F.when(F.col("pay_unit") == "hour", F.col("pay_min"))
    return upper_median(listings, keys, hourly, "median_hourly", {"listings": F.lit(True), "with_pay": has_pay()})


def listing_totals(listings: DataFrame) -> DataFrame:
    """Listings, with pay and gigs per platform, and in total (platform null)."""
    return listings.rollup("platform").agg(
        F.count("*").alias("total"),
        F.count_if(has_pay()).alias("with_pay"),
        F.count_if("worker_gig").alias("worker_gigs"),
    )


def rate_spread(listings: DataFrame) -> DataFrame:
    """Lowest, middle and highest published rate per currency, unit and location."""
    keys = ["pay_currency", "pay_unit", "location"]
    return upper_median(
        listings.filter(F.col("pay_min").isNotNull()),
        keys,
        F.col("pay_min"),
        "median",
        counts={"listings": F.lit(True)},
        lows={"lowest": F.col("pay_min")},
        highs={"highest": F.coalesce("pay_max", "pay_min")},
    )


def rank_listings(listings: DataFrame) -> DataFrame:
    """Best paid first, with ``position`` over all listings; what agrees in pay goes by company, id and the rest."""
    order = [F.coalesce("pay_min", F.lit(0.0)).desc(), *(F.col(c) for c in ("company", "external_id", "platform", "title", "url", "pay_unit"))]
    # The ranges are drawn from a sample, for which all listings would be read out of their feeds once more.
    return row_position(stored(listings), [], order, "position")
