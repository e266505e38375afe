import json

import pytest
from attesta.functions.pay import numeric_pay, prose_pay
from attesta.operators import listings as ops
from attesta.sources import feeds
from pyspark.sql import functions as F


def pay(spark, text, **options):
    return spark.createDataFrame([(text,)], "t string").select(prose_pay(F.col("t"), **options).alias("p")).head()["p"]


@pytest.mark.parametrize(
    ("text", "low", "high", "unit"),
    [
        ("$110K – $130K", 110_000, 130_000, "year"),
        ("$256K – $320K • Offers Equity", 256_000, 320_000, "year"),
        ("$15/hr", 15, None, "hour"),
        ("€9.50 per hour", 9.5, None, "hour"),
        ("$25 per task", 25, None, "task"),
        ("$1.2M annually", 1_200_000, None, "year"),
        ("usd 1,000 to 2,000 / Day", 1000, 2000, "day"),
    ],
)
def test_pay_from_prose(spark, text, low, high, unit):
    got = pay(spark, text)
    assert (got["pay_min"], got["pay_max"], got["pay_unit"]) == (low, high, unit)


@pytest.mark.parametrize("text", ["supports version 3 of the spec", "a team of 40 annotators", "$15 off", "", None])
def test_pay_refused(spark, text):
    assert pay(spark, text) is None


def test_strict_pay(spark):
    assert pay(spark, "$110 - 130K")["pay_min"] == 110
    assert pay(spark, "$110 - 130K", strict=True)["pay_min"] == 110_000
    assert pay(spark, "$5M in funding")["pay_unit"] == "year"
    assert pay(spark, "$5M in funding", strict=True) is None


def test_bare_numbers(spark):
    df = spark.createDataFrame([("16",), ("",), ("0",), ("$1,200",)], "t string")
    got = [r["p"] and (r["p"]["pay_min"], r["p"]["pay_currency"], r["p"]["pay_unit"]) for r in df.select(numeric_pay(F.col("t"), "local").alias("p")).collect()]
    assert got == [(16.0, "local", "hour"), None, None, (1200.0, "local", "hour")]


def raw(spark, platform, payload):
    return spark.createDataFrame([(platform, payload if isinstance(payload, str) else json.dumps(payload))], "platform string, payload string")


def test_lever_dates_and_units(spark):
    jobs = [
        {"id": "1", "text": "A", "createdAt": 1700000000000, "categories": {"department": "D"}, "salaryRange": {"min": 5, "max": None, "currency": "EUR", "interval": "per-hour-wage"}},
        {"id": "2", "text": "B", "createdAt": "2024-05-06T00:00:00Z", "descriptionPlain": "x " * 300 + "pays $30/hr"},
    ]
    got = {r["external_id"]: r for r in feeds.listings_lever(raw(spark, "appen", jobs)).collect()}
    assert (got["1"]["posted_at"], got["1"]["pay_unit"], got["1"]["pay_min"], got["1"]["department"]) == ("2023-11-14", "hour", 5.0, "D")
    # pay is read from the whole text, though the excerpt ends before it
    assert (got["2"]["posted_at"], got["2"]["pay_min"], len(got["2"]["description_excerpt"])) == ("2024-05-06", 30.0, 300)


def test_embedded_pages(spark):
    page = '<html><script id="__NEXT_DATA__" type="x">{"props":{"a":{"jobs":[{"id":7,"title":"T","location":{"city":"Bonn"}},{"id":8}]},"z":[1]}}</script></html>'
    got = feeds.listings_join(raw(spark, "clickworker", page)).collect()
    assert [(r["title"], r["location"], r["url"]) for r in got] == [("T", "Bonn", "https://join.com/companies/clickworker")]
    assert feeds.listings_mercor(raw(spark, "mercor", page)).count() == 1
    assert feeds.listings_join(raw(spark, "clickworker", "<html></html>")).count() == 0


def embedded(data):
    return f'<script id="__NEXT_DATA__">{data if isinstance(data, str) else json.dumps(data)}</script>'


def test_lists_lie_at_any_depth_and_text_is_no_list(spark):
    deep = {"jobs": [{"id": 3, "title": "Deep"}]}
    for k in range(12):
        deep = {f"k{k}": [1, deep]} if k % 2 else {"a": "b", f"k{k}": deep}
    text = {"note": 'a "jobs": [{"id": 1, "title": "No"}] text', "jobs": "none", "z": {"jobs": [], "y": {"jobs": [{"id": 2, "title": 'T "jobs": [{'}]}}}
    both = {"b": {"jobs": [{"id": 5, "title": "later"}]}, "a": {"x": {"jobs": [{"id": 4, "title": "first", "jobs": [{"id": 9, "title": "inner"}]}]}}}
    pages = [deep, text, both, {"jobs": [1, 2]}, [], {"jobs": None}]
    rows = spark.createDataFrame([("clickworker", embedded(p)) for p in pages], "platform string, payload string")
    assert {r["external_id"]: r["title"] for r in feeds.listings_join(rows).collect()} == {"3": "Deep", "2": 'T "jobs": [{', "4": "first"}
    assert feeds.listings_mercor(rows).count() == 3
    listed = [embedded({"jobs": [{"id": 1, "title": "j"}], "s": {"listings": [{"id": 2, "title": "l"}]}})]
    assert [r["external_id"] for r in feeds.listings_mercor(raw(spark, "mercor", listed[0])).collect()] == ["2"]


def test_broken_pages_are_counted(spark):
    pages = [embedded({"jobs": []}), embedded('{"jobs": [{"id": 1}'), embedded('{"jobs": []} {"jobs": []}'), "<html></html>", ""]
    rows = spark.createDataFrame([("join", p) for p in pages] + [("join", None)], "platform string, payload string")
    good, bad = feeds.embedded_pages(rows)
    assert (good.count(), bad.count()) == (1, 5)
    assert feeds.listings_join(bad).count() == 0


def test_listings_have_a_total_order(spark):
    columns = ["company", "external_id", "platform", "title", "url", "pay_unit"]
    rows = [(f"c{i % 3}", str(i % 7), "p", f"t{i}", "u", "hour", float(i % 5) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", pay_min double")
    want = sorted(rows, key=lambda r: (-(r[6] or 0.0), *r[:6]))
    assert [tuple(r)[:7] for r in ops.rank_listings(df).orderBy("position").collect()] == want
    assert [r["position"] for r in ops.rank_listings(df).orderBy("position").collect()] == list(range(1, 61))


def test_own_feed_and_gigs(spark):
    feeds.register_feed("own", lambda df: feeds.listings_imerit(df))
    rows = feeds.read_feed("own", raw(spark, "imerit", {"jobs": [{"id": 1, "title": "X", "pay_rate": "16"}]}))
    assert rows.head()["pay_currency"] == "local"
    day = spark.createDataFrame([(False, "day"), (False, "year"), (None, None)], "worker_gig boolean, pay_unit string")
    assert [r["worker_gig"] for r in ops.flag_gigs(day).collect()] == [True, False, False]


def test_short_country_codes_stand_alone(spark):
    df = spark.createDataFrame([("Indonesia",), ("Pune, IN",), ("United Kingdom",)], "location string")
    for c in ("title", "department", "description_excerpt", "employment_type"):
        df = df.withColumn(c, F.lit(""))
    got = {r["location"] for r in ops.filter_listings(df, countries=["in", "kingdom"]).collect()}
    assert got == {"Pune, IN", "United Kingdom"}


def test_words_far_into_a_description_decide(spark):


    far = "filler " * 100
    jobs = [{"id": i, "title": "Role", "content": f"<p>{far}{word}</p>"} for i, word in enumerate(("beekeeping", "beekeeping unpaid", "plain"))]
    raw = spark.createDataFrame([("invisible", json.dumps({"jobs": jobs}))], "platform string, payload string")
    got = ops.filter_listings(feeds.listings_greenhouse(raw), ["Beekeeping"], ["unpaid"]).collect()
    assert [r["external_id"] for r in got] == ["0"] and len(got[0]["description_excerpt"]) == 300


def test_lists_in_pages_are_read_in_their_rows(spark, monkeypatch):
    """Where a list's key occurs once it needs no levels; text that looks like it, or codes, give what the levels give."""
    from attesta.sources import feeds

    page = '<script id="__NEXT_DATA__" type="application/json">{}</script>'
    job = '{{"title":"Role {0}","id":{0}}}'.format
    plain = [
        '{"a":{"b":[1,{"jobs" : [ ' + job(1) + ',' + job(2) + '],"z":1.50}]}}',
        '{"note":"\\"jobs\\":[{","jobs":[' + job(3) + ']}',
        '{"jobs":[]}', '{"jobs":["x"]}', '{"jobs":[{"title":"cut"}', "",
    ]
    level = ['{"a":{"jobs":[' + job(4) + ']},"jobs":[' + job(5) + ']}', '{"\\u006aobs":[' + job(6) + ']}']
    rows = lambda texts: spark.createDataFrame([("clickworker", page.format(t) if t else None) for t in texts], "platform string, payload string")
    titles = lambda texts: sorted(r.title for r in feeds.listings_join(rows(texts)).collect())
    assert titles(plain + level) == ["Role 1", "Role 2", "Role 3", "Role 5", "Role 6"]
    seen = []
    whole = feeds.deep_lists
    monkeypatch.setattr(feeds, "deep_lists", lambda pages, key: seen.append(pages.count()) or whole(pages, key))
    assert titles(plain) == ["Role 1", "Role 2", "Role 3"] and seen == [0]


def test_ranking_makes_each_listing_once(spark):
    made = spark.sparkContext.accumulator(0)
    columns = ["company", "external_id", "platform", "title", "url", "pay_unit"]

    def row(i):
        made.add(1)
        return ("c", str(i), "p", "t", "u", "hour", float(i % 5))

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(row), ", ".join(f"{c} string" for c in columns) + ", pay_min double")
    assert sorted(r["position"] for r in ops.rank_listings(df).collect()) == list(range(1, 41))
    assert made.value == 40


def test_pages_and_pay_are_searched_once(spark):
    rows = raw(spark, "handshake", {"jobs": [{"id": 1, "compensation": {"compensationTierSummary": "$20 - $30 per hour • Equity"}}, {"id": 2}]})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = feeds.listings_ashby(rows)
    assert [(r["pay_min"], r["pay_max"], r["pay_unit"], r["pay_raw"], r["pay_source"]) for r in got.orderBy("external_id").collect()] == [
        (20.0, 30.0, "hour", "$20 - $30 per hour • Equity", "structured"), (None, None, "", "", "")
    ]
    assert plan(got.select("pay_min", "pay_unit")).count("regexp_extract(") == 1
    pages = raw(spark, "clickworker", embedded({"jobs": [{"id": 1, "title": "T"}]}))
    pages = pages.select("platform", F.concat("payload", F.lit("<p>made</p>")).alias("payload"))
    got = feeds.listings_join(pages)
    assert [r["title"] for r in got.collect()] == ["T"]
    assert plan(got).count("regexp_extract(") == 1 and plan(got).count("<p>made</p>") <= 1
