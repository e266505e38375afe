import datetime as dt
import json

import pytest
from attesta.functions.dates import resolve_day, resolve_window
from attesta.fixed_values import MAX_DIMENSIONS, REPORT_RECIPES
from attesta.operators import reports
from attesta.sources import statistics as stats
from pyspark.sql import functions as F

DAY = dt.date(2024, 3, 2)


def test_report_days():
    days = {" Yesterday": (2024, 3, 1), "30d": (2024, 2, 2), "1d": (2024, 3, 2), "0d": (2024, 3, 2), "2dago": (2024, 2, 29), "61DaysAgo": (2024, 1, 1), "2023-12-24": (2023, 12, 24)}
    assert {t: resolve_day(t, DAY) for t in days} == {t: dt.date(*d) for t, d in days.items()}
    assert resolve_window("2dAgo", "yesterday", DAY) == (dt.date(2024, 2, 29), dt.date(2024, 3, 1))
    for wrong in ("", "soon", "d", "-3d", "2024-02-30"):
        with pytest.raises(ValueError, match="no report day"):
            resolve_day(wrong, DAY)
    with pytest.raises(ValueError, match="after"):
        resolve_window("today", "2d", DAY)


def test_dimension_guard(spark):
    df = spark.createDataFrame([tuple("x" * 10)], ", ".join(f"d{i} string" for i in range(10)))
    with pytest.raises(ValueError, match="at most 9 dimensions"):
        reports.report(df, [f"d{i}" for i in range(10)], ["sessions"])
    assert all(len(d) <= MAX_DIMENSIONS and m for d, m, _ in REPORT_RECIPES.values())


def test_sessions_against_brute_force(spark):
    start = 1_700_000_000
    events = [(i, start + (i * i * 97) % 40_000, i % 3, ("view", "click", "purchase")[i % 3 if i % 5 else 1], f"c{i % 4}") for i in range(400)]
    df = spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string, country string").withColumn("ts", F.timestamp_seconds("s"))
    for gap in (60, 300, 1800):
        want = []
        for user in range(3):
            last = None
            for e in sorted((e for e in events if e[2] == user), key=lambda e: (e[1], e[0])):
                if last is None or e[1] - last > gap:
                    want.append([user, e[1], e[1], 0, e[4]])
                want[-1][2], want[-1][3], last = e[1], want[-1][3] + 1, e[1]
        got = [
            [r["user_id"], int(r["started_at"].timestamp()), int(r["started_at"].timestamp()) + r["duration_us"] // 1_000_000, r["events"], r["country"]]
            for r in reports.sessions(df, ["country"], gap).select("user_id", F.col("started_at"), "duration_us", "events", "country").collect()
        ]
        offset = want[0][1] - sorted(got)[0][1]
        assert sorted([g[0], g[1] + offset, g[2] + offset, *g[3:]] for g in got) == sorted(want)


def test_rows_unknown_everywhere_go(spark):
    df = spark.createDataFrame([("(not set)", "(not set)"), ("(not set)", "x")], "a string, b string")
    assert reports.drop_all_not_set(df, ["a", "b"]).count() == 1


def cube(spark, payload):
    return stats.flatten_jsonstat(spark.createDataFrame([("s", json.dumps(payload))], "source string, payload string"))


def test_jsonstat_positions_sparse_values_and_label_only_dims(spark):
    payload = {
        "id": ["geo", "time", "unit"], "size": [2, 2, 1],
        "dimension": {
            "geo": {"category": {"index": {"DE": 1, "AT": 0}, "label": {"DE": "Germany", "AT": "Austria"}}},
            "time": {"category": {"index": ["2020", "2021"]}},
            "unit": {"category": {"label": {"N": "Number"}}},
        },
        "value": [1, None, 3.5, 4],
    }
    want = {("Austria", "2020", 1.0), ("Germany", "2020", 3.5), ("Germany", "2021", 4.0)}
    rows = cube(spark, payload).collect()
    assert {(r["dims"]["geo"], r["dims"]["time"], r["value"]) for r in rows} == want
    assert {r["dims"]["unit"] for r in rows} == {"Number"} and {r["codes"]["geo"] for r in rows} == {"AT", "DE"}
    payload["value"] = {"0": 1, "2": 3.5, "3": 4}
    assert {(r["dims"]["geo"], r["dims"]["time"], r["value"]) for r in cube(spark, payload).collect()} == want
    assert cube(spark, {"id": []}).count() == 0


def test_sdmx_unknown_positions(spark):
    payload = {
        "data": {
            "structures": [{"dimensions": {"observation": [{"id": "t", "values": [{"id": "2020"}, {"id": "2021", "name": "Y21"}]}, {"id": "g", "values": [{"id": "A"}]}]}}],
            "dataSets": [{"observations": {"1:0": [5, 0], "0:9": [7]}}],
        }
    }
    rows = stats.flatten_sdmx(spark.createDataFrame([(json.dumps(payload),)], "payload string")).collect()
    assert sorted((sorted(r["dims"].items()), r["value"]) for r in rows) == [([("g", "A"), ("t", "Y21")], 5.0), ([("t", "2020")], 7.0)]


def test_census_keeps_codes_and_drops_marks(spark):
    matrix = [["NAME", "B01", "state"], ["Alabama", "-666666666", "01"], ["Alaska", "12.5", "02"], ["Guam", None, "66"]]
    df = spark.createDataFrame([(json.dumps(matrix),)], "payload string")
    got = [tuple(r) for r in stats.read_census_matrix(df, ["NAME", "state"], ["B01"]).collect()]
    assert got == [("Alabama", "01", None), ("Alaska", "02", 12.5), ("Guam", "66", None)]


def payload(spark, body):
    return spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body),)], "payload string")


def test_odd_matrix_rows_stop_nothing(spark):
    body = [["NAME", "state", "pop", "state"], ["Ash", "01", "7", "02"], ["Birch"], [], ["Cedar", "03", "x", "04", "more"]]
    got = stats.read_census_matrix(payload(spark, body), ["NAME", "state", "none"], ["pop"]).collect()
    assert [tuple(r) for r in got] == [("Ash", "02", None, 7.0), ("Birch", None, None, None), (None, None, None, None), ("Cedar", "04", None, None)]
    assert stats.read_census_matrix(payload(spark, "[broken"), ["NAME"], ["pop"]).count() == 0


def test_a_short_report_row_stops_nothing(spark):
    from attesta.sources.analytics import read_report_payload

    body = {
        "dimensionHeaders": [{"name": "day"}, {"name": "page"}],
        "metricHeaders": [{"name": "hits"}],
        "rows": [{"dimensionValues": [{"value": "mon"}], "metricValues": []}, {"dimensionValues": [{"value": "tue"}, {"value": "/"}], "metricValues": [{"value": "3"}]}],
    }
    got = read_report_payload(payload(spark, body), ["day", "page"], ["hits"]).collect()
    assert [tuple(r) for r in got] == [("mon", None, None), ("tue", "/", 3.0)]


def test_odd_cubes_stop_nothing(spark):
    category = {"category": {"index": ["a", "b"]}}
    cube = {"id": ["x", "extra"], "size": [2], "dimension": {"x": category}, "value": [1, ":"]}
    assert [(r["codes"], r["value"]) for r in stats.flatten_jsonstat(payload(spark, cube)).collect()] == [({"x": "a"}, 1.0)]
    cube = {"id": ["x"], "size": [2, 9], "dimension": {"x": category}, "value": {"1": "2.5", "odd": 3}}
    assert [(r["codes"], r["value"]) for r in stats.flatten_jsonstat(payload(spark, cube)).collect()] == [({"x": "b"}, 2.5)]


def test_a_dimension_of_series_and_observation(spark):
    place, year = ({"id": i, "values": [{"id": v, "name": v} for v in vs]} for i, vs in (("place", ["p", "q"]), ("year", ["1990", "1991"])))
    body = {
        "structure": {"dimensions": {"series": [place, year], "observation": [year]}},
        "dataSets": [{"series": {"1:0": {"observations": {"1": [4.5]}}}}],
    }
    assert [(r["dims"], r["value"]) for r in stats.flatten_sdmx(payload(spark, body)).collect()] == [({"place": "q", "year": "1991"}, 4.5)]


def test_window_reads_its_days_alone(spark, tmp_path):
    import datetime as dt

    from attesta.operators import reports as ops

    rows = [(i, 86_400 * (19_700 + i % 10) + i, i % 7, "view" if i % 2 else "purchase", f"Page {i % 3}", None if i % 5 == 0 else "(not set)" if i % 5 == 1 else "web") for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id int, event_type string, page string, kind string").withColumn("ts", F.timestamp_seconds("s")).withColumn("eventName", F.col("event_type"))
    ops.write_days(events, str(tmp_path))
    last = dt.date(1970, 1, 1) + dt.timedelta(days=19_709)
    report = ops.window_report(spark.read.parquet(str(tmp_path)), ["kind"], ["eventCount", "activeUsers"], ("3daysAgo", "yesterday"), last, [("page", "not ends", [" 2"])])
    assert "PartitionFilters: [isnotnull(day" in report._jdf.queryExecution().executedPlan().toString()
    kept = [r for r in rows if 6 <= r[0] % 10 <= 8 and not r[4].endswith("2") and r[5] != "(not set)"]
    want = {(k, False): [r for r in kept if r[5] == k] for k in {r[5] for r in kept}} | {(None, True): kept}
    assert {(r["kind"], r["is_total"]): (r["eventCount"], r["activeUsers"]) for r in report.collect()} == {k: (len(v), len({r[2] for r in v})) for k, v in want.items()}


def test_filters(spark):
    import pytest
    from attesta.operators import reports as ops

    df = spark.createDataFrame([("Alpha",), ("beta",), (None,)], "d string")
    keep = lambda *f: [r["d"] for r in df.where(ops.matching([f])).collect()]
    assert keep("d", "is", ["ALPHA"]) == ["Alpha"] and keep("d", "not is", ["alpha"]) == ["beta", None]
    assert keep("d", "contains", ["ET", "zz"]) == ["beta"] and keep("d", "ends", ["a"]) == ["Alpha", "beta"] and keep("d", "matches", ["^[ab]l"]) == ["Alpha"]
    for bad in (("d", "like", ["x"]), ("d", "is", [])):
        with pytest.raises(ValueError):
            ops.matching([bad])


def test_totals_of_payloads(spark):
    from attesta.sources.analytics import read_report_totals

    head = '"metricHeaders":[{"name":"a"},{"name":"b"}]'
    rows = [
        (1, "{%s,\"rows\":[{},{}],\"totals\":[{\"metricValues\":[{\"value\":\"7\"},{\"value\":\"x\"}]}],\"rowCount\":3}" % head),
        (2, "{%s,\"rows\":[{}]}" % head), (3, "not json"), (4, None),
    ]
    got = read_report_totals(spark.createDataFrame(rows, "k int, payload string"), ["a", "b"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 7.0, None, 3, 2, False), (2, None, None, 1, 1, True), (3, None, None, 0, 0, True), (4, None, None, 0, 0, True)]
