"""Pay from prose and from bare numbers, as structs of four typed fields and two labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CURRENCY_SYMBOLS, MONEY_PATTERN, MULTIPLIERS, UNIT_SYNONYMS
from .text import let, safe_double

PAY_TYPE = (
    "struct<pay_min:double,pay_max:double,pay_currency:string,pay_unit:string,"
    "pay_raw:string,pay_source:string>"
)


def no_pay() -> Column:
    return F.lit(None).cast(PAY_TYPE)


def _choose(col: Column, table: dict, default: Column) -> Column:
    out = default
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def _pay(low: Column, high: Column, currency: Column, unit: Column, raw: Column, source: str) -> Column:
    return F.struct(
        low.cast("double").alias("pay_min"),
        high.cast("double").alias("pay_max"),
        currency.alias("pay_currency"),
        unit.alias("pay_unit"),
        raw.alias("pay_raw"),
        F.lit(source).alias("pay_source"),
    )


def prose_pay(text: Column, strict: bool = False) -> Column:
    """First money amount or range in a text; null when there is none worth trusting.

    The text is searched once and its match split into parts once. ``strict`` gives the
    low end the high end's K or M, and takes K or M without a unit only when both ends
    are given.
    """
    found = F.regexp_extract(F.coalesce(text, F.lit("")), MONEY_PATTERN, 0)
    parts = F.split(F.regexp_replace(found, MONEY_PATTERN, "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$0"), "\x01")
    return let(parts, lambda p: F.when(F.size(p) == 7, _read_parts(p, strict)))


def _read_parts(p: Column, strict: bool) -> Column:
    low_suffix, high_suffix = F.lower(p[2]), F.lower(p[4])
    facts = F.struct(
        safe_double(p[1]).alias("low"),
        safe_double(p[3]).alias("high"),
        F.lower(p[5]).alias("word"),
        _choose(low_suffix, MULTIPLIERS, F.lit(1)).alias("low_factor"),
        _choose(high_suffix, MULTIPLIERS, F.lit(1)).alias("high_factor"),
    )
    return let(facts, lambda f: _priced(p, f, strict))


def _priced(p: Column, f: Column, strict: bool) -> Column:
    word, low, high, low_factor = f["word"], f["low"], f["high"], f["low_factor"]
    high_factor = F.when(p[4] == "", low_factor).otherwise(f["high_factor"])
    if strict:
        low_factor = F.when(high.isNotNull() & (p[2] == ""), high_factor).otherwise(low_factor)
    unit = (
        F.when(word == "", F.when(low_factor > 1, "year").otherwise(""))
        .when(word.contains("h"), "hour")
        .when(word.contains("yr") | word.contains("year") | word.contains("annual"), "year")
        .when(word.contains("task"), "task")
        .otherwise("day")
    )
    refused = low.isNull() | ((word == "") & (low_factor == 1) & (low < 100))
    if strict:
        refused = refused | ((low_factor > 1) & (word == "") & high.isNull())
    currency = _choose(p[0], CURRENCY_SYMBOLS, F.upper(p[0]))
    return F.when(~refused, _pay(low * low_factor, high * high_factor, currency, unit, F.trim(p[6]), "parsed"))


def numeric_pay(value: Column, currency: Column | str = "USD", unit: str = "hour") -> Column:
    """Pay from a bare number whose currency and period the caller knows; zero is refused."""
    currency = F.lit(currency) if isinstance(currency, str) else currency
    amount = safe_double(value)
    nothing = F.lit(None).cast("double")
    return F.when(amount > 0, _pay(amount, nothing, currency, F.lit(unit), value.cast("string"), "structured"))


def stated_pay(low: Column, high: Column, currency: Column, interval: Column, raw: Column) -> Column:
    """Pay from structured fields; the interval is mapped to the units prose gives."""
    unit = F.regexp_replace(F.coalesce(interval, F.lit("")), "per-", "")
    unit = _choose(unit, UNIT_SYNONYMS, unit)
    return F.when(
        (F.coalesce(low, F.lit(0.0)) != 0) | (F.coalesce(high, F.lit(0.0)) != 0),
        _pay(low, high, F.coalesce(currency, F.lit("")), unit, raw, "structured"),
    )
