"""Job feeds and pay: registered queries and their checks.

Every order is a job posting; each feed's payload holds that posting the way the
feed would publish it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pay import prose_pay
from ..operators import listings as ops
from ..operators.ordered import first_rows
from ..session import shared_folder
from ..sources import feeds
from . import sql
from . import tables as t

QUERIES: dict = {}
CHECKS: dict = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        # the whole description is carried for filters and not shown
        QUERIES[name] = lambda spark, sf_dir: fn(spark, sf_dir).drop(feeds.WHOLE_TEXT)
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


# postings -----------------------------------------------------------------------------


_stored: dict[tuple[str, str], str] = {}


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings, joined and stored once per application: nine feeds are made from them."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stored:
        path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
        _postings(spark, sf_dir).write.parquet(path)
        _stored[at] = path
    return spark.read.parquet(_stored[at])


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rate = (F.lit(10) + k % 40).cast("string")
    form = k % 8
    pay_text = (
        F.when(form == 0, F.concat(F.lit("pays $"), rate, F.lit("/hr, weekly")))
        .when(form == 1, F.concat(F.lit("$"), F.lit(50) + k % 40, F.lit("K – $"), F.lit(100) + k % 90, F.lit("K • Offers Equity")))
        .when(form == 2, F.concat(F.lit("from €"), rate, F.lit(".50 per hour")))
        .when(form == 3, F.concat(F.lit("USD 1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" to 2,500 per year")))
        .when(form == 4, F.concat(F.lit("supports version "), (k % 10).cast("string"), F.lit(" of the spec")))
        .when(form == 5, F.concat(F.lit("£"), rate, F.lit(" per task")))
        .when(form == 6, F.concat(F.lit("₹"), F.lit(100) + k % 900, F.lit(" / day")))
        .otherwise(F.concat(F.lit("about $"), rate))
    )
    roles = F.array(*[F.lit(r) for r in ("Data Annotator", "Search Quality Rater", "Account Executive")])
    orders = t.table(spark, sf_dir, "orders")
    customers = t.table(spark, sf_dir, "customer")
    nations = t.table(spark, sf_dir, "nation")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("k"),
            rate.alias("rate"),
            F.concat_ws(" ", F.get(roles, (k % 3).cast("int")), k.cast("string")).alias("title"),
            F.col("n_name").alias("location"),
            F.col("c_mktsegment").alias("department"),
            F.when(k % 2 == 0, "Contract").otherwise("Full-time").alias("employment"),
            F.col("o_orderdate").cast("timestamp").alias("posted"),
            pay_text.alias("pay_text"),
            F.concat(F.lit("<p>"), "o_orderpriority", F.lit(" &amp; remote.</p> <b>"), pay_text, F.lit("</b>")).alias("description"),
        )
    )


_POSTINGS = """
posted AS (
  SELECT o_orderkey AS k, CAST(10 + o_orderkey % 40 AS VARCHAR) AS rate, o_orderkey % 8 AS form,
         (['Data Annotator', 'Search Quality Rater', 'Account Executive'])[1 + o_orderkey % 3] || ' ' || o_orderkey AS title,
         n_name AS location, c_mktsegment AS department, CASE WHEN o_orderkey % 2 = 0 THEN 'Contract' ELSE 'Full-time' END AS employment,
         strftime(o_orderdate, '%Y-%m-%d') AS posted, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
prose AS (
  SELECT *, priority || ' remote. ' || pay_text AS excerpt, '<p>' || priority || ' &amp; remote.</p> <b>' || pay_text || '</b>' AS description,
         CASE WHEN p_raw IS NOT NULL THEN 'parsed' END AS p_source
  FROM (SELECT *,
    CASE form WHEN 0 THEN 'pays $' || rate || '/hr, weekly' WHEN 1 THEN '$' || (50 + k % 40) || 'K – $' || (100 + k % 90) || 'K • Offers Equity'
              WHEN 2 THEN 'from €' || rate || '.50 per hour' WHEN 3 THEN 'USD 1,' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ' to 2,500 per year'
              WHEN 4 THEN 'supports version ' || (k % 10) || ' of the spec' WHEN 5 THEN '£' || rate || ' per task'
              WHEN 6 THEN '₹' || (100 + k % 900) || ' / day' ELSE 'about $' || rate END AS pay_text,
    CAST(CASE form WHEN 0 THEN 10 + k % 40 WHEN 1 THEN 1000 * (50 + k % 40) WHEN 2 THEN 10.5 + k % 40 WHEN 3 THEN 1000 + k % 1000
              WHEN 5 THEN 10 + k % 40 WHEN 6 THEN 100 + k % 900 END AS DOUBLE) AS p_min,
    CAST(CASE form WHEN 1 THEN 1000 * (100 + k % 90) WHEN 3 THEN 2500 END AS DOUBLE) AS p_max,
    CASE form WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'USD' WHEN 5 THEN 'GBP' WHEN 6 THEN 'INR' END AS p_currency,
    CASE form WHEN 0 THEN 'hour' WHEN 1 THEN 'year' WHEN 2 THEN 'hour' WHEN 3 THEN 'year' WHEN 5 THEN 'task' WHEN 6 THEN '' END AS p_unit,
    CASE form WHEN 0 THEN '$' || rate || '/hr' WHEN 1 THEN '$' || (50 + k % 40) || 'K – $' || (100 + k % 90) || 'K'
              WHEN 2 THEN '€' || rate || '.50 per hour' WHEN 3 THEN 'USD 1,' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ' to 2,500 per year'
              WHEN 5 THEN '£' || rate || ' per task' WHEN 6 THEN '₹' || (100 + k % 900) || ' / day' END AS p_raw
    FROM posted)
)""".replace("WHEN 6 THEN '' END AS p_unit", "WHEN 6 THEN 'day' END AS p_unit")


def _expected(
    platform: str, company: str, pay: str = "prose", gig: str = "false", source: str = "p_source", raw: str = "p_raw", **cols: str
) -> str:
    """SQL for one feed's listings; ``pay`` is prose, none or hourly."""
    values = {
        "platform": f"'{platform}'", "company": f"'{company}'", "title": "title", "url": "''", "location": "location",
        "department": "''", "employment_type": "''", "posted_at": "''", "remote": "''", "external_id": "CAST(k AS VARCHAR)",
        "description_excerpt": "excerpt", "worker_gig": gig,
    }
    if pay == "prose":
        values |= {"pay_min": "p_min", "pay_max": "p_max", "pay_currency": "coalesce(p_currency, '')", "pay_unit": "coalesce(p_unit, '')",
                   "pay_raw": f"coalesce({raw}, '')", "pay_source": f"coalesce({source}, '')"}
    else:
        some = pay == "hourly"
        values |= {"pay_min": "CAST(rate AS DOUBLE)" if some else "NULL::DOUBLE", "pay_max": "NULL::DOUBLE", "pay_currency": "'USD'" if some else "''",
                   "pay_unit": "'hour'" if some else "''", "pay_raw": "rate" if some else "''", "pay_source": "'structured'" if some else "''"}
    values |= cols
    return "SELECT " + ", ".join(f"{v} AS {n}" for n, v in values.items()) + " FROM prose"


def _raw(rows: DataFrame, platform: str, payload) -> DataFrame:
    return rows.select(F.lit(platform).alias("platform"), payload.alias("payload"))


def _col(name: str, as_: str):
    return F.col(name).alias(as_)


def _page(inner):
    return F.concat(
        F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"state":'), inner, F.lit("}}}</script></html>")
    )


# feeds ------------------------------------------------------------------------------------


def greenhouse(spark, sf_dir):
    job = F.struct(
        _col("k", "id"), "title", F.concat(F.lit("https://boards/"), "k").alias("absolute_url"),
        F.struct(_col("location", "name")).alias("location"),
        F.array(F.struct(_col("department", "name")), F.struct(F.lit("Delivery").alias("name"))).alias("departments"),
        F.concat(F.date_format("posted", "yyyy-MM-dd"), F.lit("T09:00:00Z")).alias("updated_at"), _col("description", "content"),
        F.array(F.struct(F.lit("Team").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("Employment Type").alias("name"), _col("employment", "value"))).alias("metadata"),
    )
    raw = _raw(postings(spark, sf_dir), "invisible", F.to_json(F.struct(F.array(job).alias("jobs"))))
    return feeds.listings_greenhouse(raw)


_GREENHOUSE = _expected(
    "invisible", "Invisible Technologies", url="'https://boards/' || k", department="department || ', Delivery'", employment_type="employment", posted_at="posted"
)
query("listings_greenhouse", sql.with_ctes(_POSTINGS) + _GREENHOUSE)(greenhouse)


def lever(spark, sf_dir):
    stated = F.col("k") % 4 == 1
    job = F.struct(
        F.col("k").cast("string").alias("id"), _col("title", "text"), F.concat(F.lit("https://lever/"), "k").alias("hostedUrl"),
        F.unix_millis("posted").alias("createdAt"), _col("description", "descriptionPlain"),
        F.struct("location", _col("department", "team"), _col("employment", "commitment"), F.array("location").alias("allLocations")).alias("categories"),
        F.when(stated, F.struct((F.lit(20) + F.col("k") % 30).alias("min"), F.lit(60).alias("max"), F.lit("USD").alias("currency"), F.lit("per-hour-wage").alias("interval"))).alias("salaryRange"),
    )
    return feeds.listings_lever(_raw(postings(spark, sf_dir), "appen", F.to_json(F.array(job))))


_STATED = "CASE WHEN k % 4 = 1 THEN {} ELSE {} END"
_LEVER = _expected(
    "appen", "Appen", url="'https://lever/' || k", department="department", employment_type="employment", posted_at="posted", remote="location",
    pay_min=_STATED.format("CAST(20 + k % 30 AS DOUBLE)", "p_min"), pay_max=_STATED.format("60.0::DOUBLE", "p_max"),
    pay_currency=_STATED.format("'USD'", "coalesce(p_currency, '')"), pay_unit=_STATED.format("'hour'", "coalesce(p_unit, '')"),
    pay_raw=_STATED.format("""'{"min":' || (20 + k % 30) || '.0,"max":60.0,"currency":"USD","interval":"per-hour-wage"}'""", "coalesce(p_raw, '')"),
    pay_source=_STATED.format("'structured'", "coalesce(p_source, '')"),
)
query("listings_lever", sql.with_ctes(_POSTINGS) + _LEVER)(lever)


def ashby(spark, sf_dir):
    job = F.struct(
        F.col("k").cast("string").alias("id"), "title", F.concat(F.lit("https://ashby/"), "k").alias("jobUrl"), "location",
        F.when(F.col("k") % 2 == 0, F.col("department")).alias("department"), _col("department", "team"), _col("employment", "employmentType"),
        F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss").alias("publishedAt"), (F.col("k") % 5 == 0).alias("isRemote"), _col("description", "descriptionPlain"),
        F.struct(_col("pay_text", "compensationTierSummary")).alias("compensation"),
    )
    raw = _raw(postings(spark, sf_dir), "handshake", F.to_json(F.struct(F.array(job).alias("jobs"))))
    return feeds.listings_ashby(raw)


_ASHBY = _expected(
    "handshake", "Handshake", url="'https://ashby/' || k", department="department", employment_type="employment", posted_at="posted",
    remote="CASE WHEN k % 5 = 0 THEN 'remote' ELSE '' END", source="CASE WHEN p_raw IS NOT NULL THEN 'structured' END",
    raw="CASE WHEN p_raw IS NOT NULL THEN pay_text END",
)
query("listings_ashby", sql.with_ctes(_POSTINGS) + _ASHBY)(ashby)


def join_feed(spark, sf_dir):
    place = F.struct(_col("location", "city"), F.lit("x").alias("country"))
    job = F.struct(_col("k", "id"), "title", place.alias("location"), _col("employment", "employmentType"))
    inner = F.to_json(F.struct(F.struct(F.lit(1).alias("page"), F.array(job).alias("jobs")).alias("board")))
    return feeds.listings_join(_raw(postings(spark, sf_dir), "clickworker", _page(inner)))


_JOIN = _expected(
    "clickworker", "Clickworker", "none", url="'https://join.com/companies/clickworker'", employment_type="employment", description_excerpt="''"
)
query("listings_join", sql.with_ctes(_POSTINGS) + _JOIN)(join_feed)


def outlier(spark, sf_dir):
    job = F.struct(
        _col("k", "id"), _col("title", "name"), F.when(F.col("k") % 2 == 0, F.col("location")).alias("location"),
        F.when(F.col("k") % 3 == 0, F.col("rate")).alias("hourlyRate"), _col("pay_text", "rate"), "description",
    )
    return feeds.listings_outlier(_raw(postings(spark, sf_dir), "outlier", F.to_json(F.struct(F.array(job).alias("data")))))


def _either(test: str, yes: dict, no: dict) -> dict:
    return {n: f"CASE WHEN {test} THEN {yes[n]} ELSE {no[n]} END" for n in yes}


_HOURLY = {"pay_min": "CAST(rate AS DOUBLE)", "pay_max": "NULL", "pay_currency": "'USD'", "pay_unit": "'hour'", "pay_raw": "rate", "pay_source": "'structured'"}
_PROSE = {"pay_min": "p_min", "pay_max": "p_max", "pay_currency": "coalesce(p_currency, '')", "pay_unit": "coalesce(p_unit, '')",
          "pay_raw": "coalesce(p_raw, '')", "pay_source": "coalesce(p_source, '')"}
_OUTLIER = _expected(
    "outlier", "Outlier (Scale AI)", gig="true", url="'https://app.outlier.ai/en/expert/opportunities'",
    location="CASE WHEN k % 2 = 0 THEN location ELSE 'remote' END", **_either("k % 3 = 0", _HOURLY, _PROSE),
)
query("listings_outlier", sql.with_ctes(_POSTINGS) + _OUTLIER)(outlier)


def mercor(spark, sf_dir):
    job = F.struct(_col("k", "id"), "title", "location", "description", F.col("rate").cast("int").alias("payRate"))
    inner = F.to_json(F.struct(F.array(job).alias("listings"), F.lit(2).alias("total")))
    return feeds.listings_mercor(_raw(postings(spark, sf_dir), "mercor", _page(inner)))


_MERCOR = _expected("mercor", "Mercor", "hourly", gig="true", url="CASE WHEN k = 0 THEN '' ELSE 'https://work.mercor.com/jobs/' || k END")
query("listings_mercor", sql.with_ctes(_POSTINGS) + _MERCOR)(mercor)


def micro1(spark, sf_dir):
    job = F.struct(
        _col("k", "_id"), _col("title", "job_title"), "location", "description",
        F.when(F.col("k") % 3 == 0, F.col("rate").cast("int")).alias("hourly_rate"),
    )
    payload = F.to_json(F.struct(F.struct(F.array(job).alias("jobs")).alias("data")))
    return feeds.listings_micro1(_raw(postings(spark, sf_dir), "micro1", payload))


_MICRO1 = _expected("micro1", "Micro1", gig="true", url="'https://micro1.ai/jobs'", **_either("k % 3 = 0", _HOURLY, _PROSE))
query("listings_micro1", sql.with_ctes(_POSTINGS) + _MICRO1)(micro1)


def imerit(spark, sf_dir):
    job = F.struct(
        _col("k", "id"), "title", F.lit("").alias("apply_link"), "location", _col("employment", "job_type"),
        F.date_format("posted", "yyyy-MM-dd HH:mm").alias("posted_date"), "description",
        F.when(F.col("k") % 3 == 0, F.col("rate")).otherwise(F.col("pay_text")).alias("pay_rate"),
    )
    return feeds.listings_imerit(_raw(postings(spark, sf_dir), "imerit", F.to_json(F.struct(F.array(job).alias("jobs")))))


_IMERIT = _expected(
    "imerit", "iMerit", gig="true", url="'https://imerit.ai/jobs.json'", employment_type="employment", posted_at="posted",
    **_either("k % 3 = 0", _HOURLY | {"pay_currency": "'local'"}, _PROSE),
)
query("listings_imerit", sql.with_ctes(_POSTINGS) + _IMERIT)(imerit)


_PAGE_LINES = (
    _expected(
        "telus-gigs", "TELUS AI Community (crowd gigs)", gig="true", url="'https://gigs/' || k", title="title || ' ' || pay_text",
        location="''", external_id="''", description_excerpt="''",
    )
    + " WHERE k % 3 <> 2"
)


@query("listings_page_lines", sql.with_ctes(_POSTINGS) + _PAGE_LINES)
def listings_page_lines(spark, sf_dir):
    text = F.concat(F.lit("# Open roles\n\n- **"), "title", F.lit(" "), "pay_text", F.lit("**\n- Short\nNo role here at all"))
    pages = postings(spark, sf_dir).select(
        F.lit("telus-gigs").alias("platform"), F.concat(F.lit("https://gigs/"), "k").alias("url"), text.alias("markdown")
    )
    return feeds.listings_from_page_lines(pages)


# pay and listings ---------------------------------------------------------------------------


@query(
    "extract_pay",
    sql.with_ctes(_POSTINGS)
    + "SELECT k, p_min AS pay_min, p_max AS pay_max, p_currency AS pay_currency, p_unit AS pay_unit, p_raw AS pay_raw, p_source AS pay_source FROM prose",
)
def extract_pay(spark, sf_dir):
    return postings(spark, sf_dir).select("k", prose_pay(F.col("description")).alias("p")).select("k", "p.*")


def all_listings(spark, sf_dir):
    """All nine feeds as one table, gigs inferred from the pay unit."""
    readers = (greenhouse, lever, ashby, join_feed, outlier, mercor, micro1, imerit, listings_page_lines)
    return ops.flag_gigs(feeds.union_listings(*[reader(spark, sf_dir) for reader in readers]))


_NINE = " UNION ALL BY NAME ".join(
    f"SELECT * FROM ({feed})" for feed in (_GREENHOUSE, _LEVER, _ASHBY, _JOIN, _OUTLIER, _MERCOR, _MICRO1, _IMERIT, _PAGE_LINES)
)
_ALL = f"""
unioned AS ({_NINE}),
listings AS (SELECT * REPLACE (worker_gig OR pay_unit IN ('hour', 'day', 'task') AS worker_gig) FROM unioned)"""


@query(
    "listings_quarantine",
    """
SELECT o_orderkey % 3 AS kind, count(*) AS pages FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL""",
)
def listings_quarantine(spark, sf_dir):
    """Pages whose embedded JSON is cut off (1) or missing (2) are counted, not lost."""
    kind = F.col("o_orderkey") % 3
    inner = F.to_json(F.struct(F.array(F.struct(F.col("o_orderkey").alias("id"))).alias("jobs")))
    page = F.when(kind == 0, _page(inner)).when(kind == 1, F.replace(_page(inner), F.lit("]}"), F.lit("]"))).otherwise(F.lit("<html></html>"))
    raw = t.table(spark, sf_dir, "orders").select(kind.alias("kind"), F.lit("join").alias("platform"), page.alias("payload"))
    return feeds.embedded_pages(raw)[1].groupBy("kind").agg(F.count("*").alias("pages"))


@query("union_listings", sql.with_ctes(_POSTINGS, _ALL) + "SELECT * FROM listings")
def union_listings(spark, sf_dir):
    return all_listings(spark, sf_dir)


_MEDIAN = "list_sort(list(pay_min) FILTER (WHERE pay_unit = 'hour' AND pay_min IS NOT NULL))"


@query(
    "pay_summary",
    sql.with_ctes(_POSTINGS, _ALL)
    + f"""
SELECT company, pay_currency, listings, with_pay, h[len(h) // 2 + 1] AS median_hourly
FROM (SELECT company, pay_currency, count(*) AS listings, count(pay_min) AS with_pay, {_MEDIAN} AS h FROM listings GROUP BY ALL)""",
)
def pay_summary(spark, sf_dir):
    return ops.pay_summary(all_listings(spark, sf_dir))


@query(
    "listing_totals",
    sql.with_ctes(_POSTINGS, _ALL)
    + """
SELECT platform, count(*) AS total, count(pay_min) AS with_pay, count(*) FILTER (WHERE worker_gig) AS worker_gigs
FROM listings GROUP BY ROLLUP (platform)""",
)
def listing_totals(spark, sf_dir):
    return ops.listing_totals(all_listings(spark, sf_dir))


@query(
    "rate_spread",
    sql.with_ctes(_POSTINGS, _ALL)
    + """
SELECT pay_currency, pay_unit, location, n AS listings, lowest, highest, h[n // 2 + 1] AS median
FROM (SELECT pay_currency, pay_unit, location, count(*) AS n, min(pay_min) AS lowest, max(coalesce(pay_max, pay_min)) AS highest,
             list_sort(list(pay_min)) AS h FROM listings WHERE pay_min IS NOT NULL GROUP BY ALL)""",
)
def rate_spread(spark, sf_dir):
    return ops.rate_spread(all_listings(spark, sf_dir))


@query(
    "filter_listings",
    sql.with_ctes(_POSTINGS, _ALL)
    + r"""
SELECT platform, external_id, title, location FROM listings
WHERE (contains(lower(title), 'rater') OR contains(lower(title || ' ' || department), 'building'))
  AND NOT contains(lower(title || ' ' || department || ' ' || description_excerpt), 'low')
  AND (regexp_matches(lower(location), '\b(1|x)\b') OR contains(lower(location), 'nation_1')) AND pay_min IS NOT NULL AND worker_gig""",
)
def filter_listings(spark, sf_dir):
    out = ops.filter_listings(
        all_listings(spark, sf_dir), ["Rater", "building"], ["LOW"], ["1", "NATION_1", "x"], pay_only=True, gigs_only=True
    )
    return out.select("platform", "external_id", "title", "location")


@query(
    "top_paid_per_company",
    sql.with_ctes(_POSTINGS, _ALL)
    + """
SELECT company, external_id, pay_min, CAST(rk AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY coalesce(pay_min, 0) DESC, external_id) AS rk FROM listings) WHERE rk <= 10""",
)
def top_paid_per_company(spark, sf_dir):
    best = first_rows(
        all_listings(spark, sf_dir), ["company"], [F.coalesce("pay_min", F.lit(0.0)).desc(), F.col("external_id")], 10, "position"
    )
    return best.select("company", "external_id", "pay_min", "position")


@query(
    "ranked_listings",
    sql.with_ctes(_POSTINGS, _ALL)
    + """
SELECT platform, company, external_id, pay_min, pay_unit,
       row_number() OVER (ORDER BY coalesce(pay_min, 0) DESC, company, external_id, platform, title, url, pay_unit) AS position
FROM listings""",
)
def ranked_listings(spark, sf_dir):
    # Of a listing, what orders it and what is shown: the ranking writes its rows to read them twice.
    listed = all_listings(spark, sf_dir).select("platform", "company", "external_id", "title", "url", "pay_min", "pay_unit")
    return ops.rank_listings(listed).select("platform", "company", "external_id", "pay_min", "pay_unit", "position")
