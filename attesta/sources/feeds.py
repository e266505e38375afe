"""Job feeds: landed payloads to one listing row type.

Every reader takes ``platform, payload`` rows and gives the same columns. A feed of
one's own is a function of the same shape, added with ``register_feed``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.loose_json import whole_json
from ..functions.pay import no_pay, numeric_pay, prose_pay, stated_pay
from ..functions.text import let, strip_markup
from ..session import cut_lineage
from .reference import PLATFORM_COLUMNS

LISTING_COLUMNS = (
    "platform", "company", "title", "url", "location", "department", "employment_type", "posted_at",
    "pay_min", "pay_max", "pay_currency", "pay_unit", "pay_raw", "pay_source",
    "remote", "worker_gig", "external_id", "description_excerpt",
)
_PAY_NUMBERS = ("pay_min", "pay_max")
WHOLE_TEXT = "_description"
_PAY_COLUMNS = tuple(c for c in LISTING_COLUMNS if c.startswith("pay_"))
_EMBEDDED = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def _given(*cols: Column) -> Column:
    """The first value that says something; empty text and zero do not."""
    return F.coalesce(*[F.when(~c.isin("", "0"), c) for c in cols])


def _plain(jobs: DataFrame, field: str) -> DataFrame:
    """Adds ``_text``: the description without markup, whole; pay and excerpt are read from it."""
    return jobs.withColumn("_text", strip_markup(F.col(f"job.{field}")))


def _excerpt() -> Column:
    return F.substring("_text", 1, fixed.EXCERPT_CHARS)


def platform_fact(fact: str) -> Column:
    """What the fixed platform table says of a row's platform; eighteen entries need no join."""
    at = PLATFORM_COLUMNS.index(fact)
    pairs = [F.lit(x) for row in fixed.PLATFORMS for x in (row[0], row[at])]
    return F.try_element_at(F.create_map(*pairs), F.col("platform"))


def _listings(jobs: DataFrame, pay: Column | None = None, gig: Column | None = None, **fields: Column) -> DataFrame:
    """Listing columns from job rows ``platform, job``; what a feed lacks is empty text."""
    rows = jobs.withColumn("_pay", no_pay() if pay is None else pay)
    out = {name: F.coalesce(fields.get(name, F.lit("")), F.lit("")) for name in LISTING_COLUMNS}
    out["platform"] = F.col("platform")
    out["company"] = F.coalesce(platform_fact("company"), F.lit(""))
    out["worker_gig"] = F.coalesce(platform_fact("worker_gigs"), F.lit(False)) if gig is None else gig
    for name in _PAY_COLUMNS:
        value = F.col(f"_pay.{name}")
        out[name] = value if name in _PAY_NUMBERS else F.coalesce(value, F.lit(""))
    # The whole text goes along as a column that is not shown, for filters; the excerpt is for readers.
    whole = F.col("_text") if "_text" in jobs.columns else F.lit("")
    return rows.select([col.alias(name) for name, col in out.items()] + [whole.alias(WHOLE_TEXT)])


def _jobs(raw: DataFrame, items: Column) -> DataFrame:
    return raw.select("platform", F.explode(items).alias("job"))


def _parsed(schema: str) -> Column:
    return F.from_json("payload", schema)


def _day(col: Column) -> Column:
    return F.substring(F.coalesce(col, F.lit("")), 1, 10)


def listings_greenhouse(raw: DataFrame) -> DataFrame:
    schema = (
        "struct<jobs:array<struct<id:string,title:string,absolute_url:string,updated_at:string,content:string,"
        "location:struct<name:string>,departments:array<struct<name:string>>,"
        "metadata:array<struct<name:string,value:string>>>>>"
    )
    jobs = _plain(_jobs(raw, _parsed(schema)["jobs"]), "content")
    types = F.filter("job.metadata", lambda m: m["name"] == "Employment Type")
    return _listings(
        jobs,
        prose_pay(F.col("_text")),
        title=F.col("job.title"),
        url=F.col("job.absolute_url"),
        location=F.col("job.location.name"),
        department=F.array_join(F.transform("job.departments", lambda d: F.coalesce(d["name"], F.lit(""))), ", "),
        employment_type=F.try_element_at(types, F.lit(-1))["value"],
        posted_at=_day(F.col("job.updated_at")),
        external_id=F.col("job.id"),
        description_excerpt=_excerpt(),
    )


def listings_lever(raw: DataFrame) -> DataFrame:
    schema = (
        "array<struct<id:string,text:string,hostedUrl:string,createdAt:string,descriptionPlain:string,"
        "categories:struct<location:string,team:string,department:string,commitment:string,allLocations:array<string>>,"
        "salaryRange:struct<min:double,max:double,currency:string,interval:string>>>"
    )
    jobs = _plain(_jobs(raw, _parsed(schema)), "descriptionPlain")
    salary = F.col("job.salaryRange")
    stated = stated_pay(salary["min"], salary["max"], salary["currency"], salary["interval"], F.to_json(salary))
    created = F.col("job.createdAt")
    millis = F.timestamp_millis(created.try_cast("bigint"))
    return _listings(
        jobs,
        F.coalesce(stated, prose_pay(F.col("_text"))),
        title=F.col("job.text"),
        url=F.col("job.hostedUrl"),
        location=F.col("job.categories.location"),
        department=_given(F.col("job.categories.team"), F.col("job.categories.department")),
        employment_type=F.col("job.categories.commitment"),
        posted_at=F.when(created.rlike(r"^\d{11,}$"), F.date_format(millis, "yyyy-MM-dd")).otherwise(_day(created)),
        external_id=F.col("job.id"),
        remote=F.get("job.categories.allLocations", F.lit(0)),
        description_excerpt=_excerpt(),
    )


def listings_ashby(raw: DataFrame) -> DataFrame:
    schema = (
        "struct<jobs:array<struct<id:string,title:string,jobUrl:string,location:string,department:string,team:string,"
        "employmentType:string,publishedAt:string,isRemote:boolean,descriptionPlain:string,"
        "compensation:struct<compensationTierSummary:string>>>>"
    )
    jobs = _plain(_jobs(raw, _parsed(schema)["jobs"]), "descriptionPlain")
    summary = F.col("job.compensation.compensationTierSummary")
    stated = lambda found: F.when(found.isNotNull(), found.withField("pay_source", F.lit("structured")).withField("pay_raw", summary))
    return _listings(
        jobs,
        let(prose_pay(summary), stated),
        title=F.col("job.title"),
        url=F.col("job.jobUrl"),
        location=F.col("job.location"),
        department=_given(F.col("job.department"), F.col("job.team")),
        employment_type=F.col("job.employmentType"),
        posted_at=_day(F.col("job.publishedAt")),
        external_id=F.col("job.id"),
        remote=F.when(F.col("job.isRemote"), "remote"),
        description_excerpt=_excerpt(),
    )


def embedded_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages as ``platform, _page, _node`` (the embedded JSON, parsed once), and pages without one or with a broken one."""
    data = F.trim(F.regexp_extract("payload", _EMBEDDED, 1))
    read = raw.withColumn("_json", whole_json(data))
    good = read.filter(F.col("_json").isNotNull())
    parsed = good.select("platform", F.monotonically_increasing_id().alias("_page"), F.try_parse_json("_json").alias("_node"))
    return cut_lineage(parsed), read.filter(F.col("_json").isNull()).drop("_json")


def deep_lists(pages: DataFrame, key: str) -> DataFrame:
    """``platform, _page, items``: the first list of objects under ``key``, at any depth, as JSON.

    The levels of the parsed JSON are opened one after another. An object that has the list is not opened further; of
    several the first stands, an object before what lies in it, siblings by position.
    """
    spark = pages.sparkSession
    here = F.try_variant_get("_node", f"$.{key}", "variant")
    is_list = F.startswith(F.schema_of_variant(F.try_variant_get("_node", f"$.{key}[0]", "variant")), F.lit("OBJECT"))
    holds = F.coalesce(is_list, F.lit(False))
    level = pages.select("platform", "_page", F.array().cast("array<int>").alias("_at"), "_node")
    found = None
    while not level.isEmpty():
        hits = level.filter(holds).select("platform", "_page", "_at", F.to_json(here).alias("items"))
        found = hits if found is None else found.unionByName(hits)
        opened = level.filter(~holds).lateralJoin(spark.tvf.variant_explode(F.col("_node").outer()))
        below = opened.select("platform", "_page", F.concat("_at", F.array("pos")).alias("_at"), F.col("value").alias("_node"))
        level = cut_lineage(below.filter(F.schema_of_variant("_node").rlike("^(OBJECT|ARRAY)")))
    if found is None:
        found = level.select("platform", "_page", "_at", F.lit("").alias("items"))
    return found.groupBy("platform", "_page").agg(F.min_by("items", "_at").alias("items"))


def _embedded_jobs(raw: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Jobs from the list under the first of ``keys`` that a page has.

    A key, a colon and the beginning of a list of objects, unescaped, are never text inside a string. So where they occur
    once in a page that spells nothing by code, that is the list, and it is read in its row. Other pages are opened level
    by level.
    """
    begins = {key: rf'(?<!\\)"{re.escape(key)}"\s*:\s*\[\s*\{{' for key in keys}
    plain = ~F.contains("payload", F.lit("\\u"))
    for begin in begins.values():
        plain = plain & (F.regexp_count("payload", F.lit(begin)) <= 1)
    plain = F.coalesce(plain, F.lit(True))  # a page that is null has no list
    # A plain column would be computed again in the filter that is pushed below it.
    read = raw.select("platform", F.explode(F.array(F.struct("payload", plain.alias("plain")))).alias("_read"))
    json = let(F.trim(F.regexp_extract("_read.payload", _EMBEDDED, 1)), whole_json)
    simple = read.filter("_read.plain").select("platform", F.explode(F.array(json)).alias("_json")).filter(F.col("_json").isNotNull())
    # What follows the list is not read.
    rests = [let(F.split("_json", begin, 2), lambda p: F.when(F.size(p) == 2, F.concat(F.lit("[{"), p[1]))) for begin in begins.values()]
    simple = simple.select("platform", F.to_json(F.try_parse_json(F.coalesce(*rests))).alias("items"))
    pages, _ = embedded_pages(read.filter("NOT _read.plain").select("platform", "_read.payload"))
    lists = simple
    for key in keys:
        some = deep_lists(pages, key)
        lists = lists.unionByName(some.select("platform", "items"))
        pages = pages.join(some.select("_page"), "_page", "left_anti")
    return _jobs(lists, F.from_json("items", f"array<{item}>"))


def listings_join(raw: DataFrame) -> DataFrame:
    item = "struct<id:string,title:string,url:string,location:string,employmentType:string>"
    jobs = _embedded_jobs(raw, ["jobs"], item).filter(F.coalesce("job.title", F.lit("")) != "")
    place = F.col("job.location")
    city = F.get_json_object(place, "$.city")
    return _listings(
        jobs,
        title=F.col("job.title"),
        url=F.coalesce(_given(F.col("job.url")), F.concat(F.lit("https://join.com/companies/"), platform_fact("token"))),
        location=F.when(place.startswith("{"), city).otherwise(place),
        employment_type=F.col("job.employmentType"),
        external_id=F.col("job.id"),
    )


def listings_outlier(raw: DataFrame) -> DataFrame:
    item = (
        "struct<id:string,title:string,name:string,url:string,location:string,description:string,"
        "payRate:string,hourlyRate:string,rate:string>"
    )
    feed = _parsed(f"struct<jobs:array<{item}>,data:array<{item}>>")
    items = F.when(F.size(feed["jobs"]) > 0, feed["jobs"]).otherwise(feed["data"])
    rate = _given(F.col("job.payRate"), F.col("job.hourlyRate"), F.col("job.rate"))
    return _listings(
        _plain(_jobs(raw, items), "description"),
        F.coalesce(prose_pay(rate), numeric_pay(rate)),
        F.lit(True),
        title=_given(F.col("job.title"), F.col("job.name")),
        url=F.coalesce("job.url", F.lit("https://app.outlier.ai/en/expert/opportunities")),
        location=F.coalesce(_given(F.col("job.location")), F.lit("remote")),
        external_id=F.col("job.id"),
        description_excerpt=_excerpt(),
    )


def listings_mercor(raw: DataFrame) -> DataFrame:
    item = "struct<id:string,title:string,location:string,description:string,hourlyRate:string,payRate:string,rate:string>"
    jobs = _embedded_jobs(raw, ["listings", "jobs"], item)
    rate = _given(F.col("job.hourlyRate"), F.col("job.payRate"), F.col("job.rate"))
    number = _given(F.col("job.id"))
    return _listings(
        _plain(jobs.filter(F.coalesce("job.title", F.lit("")) != ""), "description"),
        numeric_pay(rate),
        F.lit(True),
        title=F.col("job.title"),
        url=F.concat(F.lit("https://work.mercor.com/jobs/"), number),
        location=F.coalesce(_given(F.col("job.location")), F.lit("remote")),
        external_id=F.col("job.id"),
        description_excerpt=_excerpt(),
    )


def listings_micro1(raw: DataFrame) -> DataFrame:
    item = (
        "struct<id:string,_id:string,title:string,job_title:string,url:string,location:string,description:string,"
        "hourly_rate:string,rate:string,salary:string,currency:string>"
    )
    feed = _parsed(f"struct<data:struct<jobs:array<{item}>>,jobs:array<{item}>>")
    items = F.when(F.size(feed["data"]["jobs"]) > 0, feed["data"]["jobs"]).otherwise(feed["jobs"])
    rate = _given(F.col("job.hourly_rate"), F.col("job.rate"), F.col("job.salary"))
    return _listings(
        _plain(_jobs(raw, items), "description"),
        F.coalesce(numeric_pay(rate, F.coalesce("job.currency", F.lit("USD"))), prose_pay(F.col("job.description"))),
        F.lit(True),
        title=_given(F.col("job.title"), F.col("job.job_title")),
        url=F.coalesce(_given(F.col("job.url")), F.lit("https://micro1.ai/jobs")),
        location=F.coalesce(_given(F.col("job.location")), F.lit("remote")),
        external_id=F.coalesce(_given(F.col("job.id")), F.col("job._id")),
        description_excerpt=_excerpt(),
    )


def listings_imerit(raw: DataFrame) -> DataFrame:
    item = (
        "struct<id:string,title:string,apply_link:string,location:string,job_type:string,posted_date:string,"
        "description:string,pay_rate:string,currency:string>"
    )
    rate = F.col("job.pay_rate")
    return _listings(
        _plain(_jobs(raw, _parsed(f"struct<jobs:array<{item}>>")["jobs"]), "description"),
        F.coalesce(numeric_pay(rate, F.coalesce(_given(F.col("job.currency")), F.lit("local"))), prose_pay(rate)),
        F.lit(True),
        title=F.col("job.title"),
        url=F.coalesce(_given(F.col("job.apply_link")), F.lit("https://imerit.ai/jobs.json")),
        location=F.col("job.location"),
        employment_type=F.col("job.job_type"),
        posted_at=_day(F.col("job.posted_date")),
        external_id=F.col("job.id"),
        description_excerpt=_excerpt(),
    )


def listings_from_page_lines(pages: DataFrame) -> DataFrame:
    """Role titles among the lines of rendered pages ``platform, url, markdown``."""
    lines = pages.select("platform", "url", F.explode(F.split("markdown", "\n")).alias("line"))
    title = F.trim(F.regexp_replace("line", r"^[-* ]+|[-* ]+$", ""))
    named = lines.withColumn("_title", title).filter(
        (F.length("_title") > 12) & (F.length("_title") < 140) & F.lower("_title").rlike("|".join(fixed.ROLE_KEYWORDS))
    )
    return _listings(named, prose_pay(F.col("line")), F.lit(True), title=F.col("_title"), url=F.col("url"))


_FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": listings_greenhouse,
    "lever": listings_lever,
    "ashby": listings_ashby,
    "join": listings_join,
    "outlier": listings_outlier,
    "mercor": listings_mercor,
    "micro1": listings_micro1,
    "imerit": listings_imerit,
    "page_lines": listings_from_page_lines,
}


def register_feed(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    _FEEDS[name] = reader


def read_feed(name: str, raw: DataFrame) -> DataFrame:
    return _FEEDS[name](raw)


def union_listings(*feeds: DataFrame) -> DataFrame:
    """All feeds under one row type; a column one feed lacks is null."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out
