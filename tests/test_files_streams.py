import json

import pytest
from attesta.operators import work
from attesta.sinks import files, report
from attesta.sources import landed
from attesta.streaming import live, tables
from pyspark.sql import functions as F


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame([("Ac\"me", None, ["a", "b"], "x\ny", "supported", 3, "hidden")], "name string, empty string, urls array<string>, note string, _verdict string, _corroborations int, _key string")
    files.write_csv(df, str(tmp_path / "a"), bom=True)
    text = max((f.read_bytes() for f in (tmp_path / "a").glob("part-*.csv")), key=len).decode("utf-8")
    assert text.startswith("﻿name,empty,urls,note,verdict,corroborations\r\n")
    assert '"Ac""me",,a; b,"x' in text and text.endswith("supported,3\r\n")
    files.write_csv(df, str(tmp_path / "b"), delimiter=";", include_provenance=False, crlf=False)
    assert "verdict" not in next((tmp_path / "b").glob("part-*.csv")).read_text()


def test_jsonl_and_report(spark, tmp_path):
    df = spark.createDataFrame([("Acme", None)], "name string, country string")
    files.write_json_report(df, str(tmp_path), "T", spark.createDataFrame([(1,)], "n int"), {"run": "r"}, "told")
    rows = [json.loads(line) for p in (tmp_path / "rows").glob("part-*") for line in p.read_text().splitlines()]
    head = [json.loads(line) for p in (tmp_path / "report").glob("part-*") for line in p.read_text().splitlines()]
    assert rows == [{"name": "Acme", "country": None}]
    assert head[0]["summary"] == {"n": 1} and head[0]["meta"] == {"run": "r"}


def test_landed_run(spark, tmp_path):
    run = tmp_path / "20240101-x"
    (run / "units").mkdir(parents=True)
    (run / "pages").mkdir()
    unit = {"_key": "a::x", "_saved_at": "2024-01-01T00:00:00+00:00", "_meta": {"target": "a", "dimension": "x", "cost_usd": 0.5}, "findings": [{"name": "n"}]}
    (run / "units" / "1.json").write_text(json.dumps(unit, indent=2))
    (run / "units" / "2.json").write_text("{broken")
    (run / "pages" / "p.json").write_text(json.dumps({"url": "http://a", "status": 200, "doc": {"title": "T"}}))
    (run / "findings.json").write_text(json.dumps({"findings": [{"name": "n", "founded": 1999}]}))
    (run / "manifest.json").write_text(json.dumps({"topic": "t", "status": "running", "spec": {"planned_units": ["a::x", "b::x"]}}))
    (tmp_path / "exports").mkdir()
    units, bad = landed.read_units(spark, str(tmp_path))
    row = units.head()
    assert (row["run_id"], row["unit_key"], row["target"], row["cost_usd"], bad.count()) == ("20240101-x", "a::x", "a", 0.5, 1)
    assert landed.read_pages(spark, str(tmp_path))[0].head()["doc"]["title"] == "T"
    assert landed.read_findings(spark, str(tmp_path)).head()["finding"] == {"name": "n", "founded": "1999"}
    (tmp_path / "20230101-y").mkdir()
    (tmp_path / "20230101-y" / "manifest.json").write_text('{"topic": "t"} {"topic": "u"}')
    runs, unreadable = landed.read_runs(spark, str(tmp_path))
    assert unreadable.count() == 1
    assert landed.latest_run(runs).head()[0] == "20240101-x"
    pending = work.pending_units(landed.planned_units(runs), units)
    assert [r["unit_key"] for r in pending.collect()] == ["b::x"]
    assert work.run_progress(units).head()["cost_usd"] == 0.5


def test_checkpoint_written_twice_counts_once(spark, tmp_path):
    units = spark.createDataFrame([("r", "a::x", 1, 1, "boom"), ("r", "a::x", 2, 2, None)], "run_id string, unit_key string, saved_at int, seq int, error string")
    files.append_units(units, str(tmp_path / "u"))
    files.append_units(units, str(tmp_path / "u"))
    assert [r["error"] for r in work.latest_units(spark.read.parquet(str(tmp_path / "u"))).collect()] == [None]


def test_report_tables(spark):
    findings = spark.createDataFrame([("a", "supported", 2, "1/1", None), ("b", "refuted", 1, "0/2", ["p1", "p2", "p3"]), ("c", None, 1, None, None)], "name string, _verdict string, _corroborations long, _verdict_votes string, _problems array<string>")
    units = spark.createDataFrame([("t::d", None, "none found", "t", "d"), ("t::e", "boom", None, "t", "e")], "unit_key string, error string, gaps string, target string, dimension string")
    calls = spark.createDataFrame([("m", 1, 1)], "model string, prompt_tokens long, completion_tokens long").withColumn("cost_usd", F.lit(1).cast("decimal(20,8)"))
    frames = report.report_frames(findings, units, spark.range(1), calls)
    assert {k: v.count() for k, v in frames.items()} == {"summary": 1, "verified": 1, "unverified": 1, "refuted": 1, "gaps": 1, "failures": 1, "spend_by_model": 2}
    assert frames["refuted"].head()["_problems"] == ["p1", "p2", "p3"]
    assert all(frames[k].columns[0] == "name" for k in ("verified", "unverified", "refuted"))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    calls = spark.createDataFrame([("r1", 0.4), ("r2", 0.1)], "run_id string, c double").select("run_id", F.col("c").cast("decimal(20,8)").alias("cost_usd"))
    calls.write.mode("append").parquet(src)
    limit = F.lit("1.0").cast("decimal(20,8)")
    assert live.budget_alerts(live.file_stream(spark, src), limit, folder).count() == 0
    for expected in (0, 1, 1, 1):
        calls.write.mode("append").parquet(src)
        alerts = live.budget_alerts(live.file_stream(spark, src), limit, folder).collect()
        assert [r["run_id"] for r in alerts] == ["r1"] * expected


def test_levels_over_fifty_batches_a_replay_and_a_crash(spark, tmp_path, monkeypatch):
    from attesta.streaming.levels import Levels
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("k", StringType()), StructField("n", LongType()), StructField("batch_id", LongType())])

    def merge(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("batch_id").alias("batch_id"))

    table = Levels(spark, f"{tmp_path}/t", schema, merge, fan=3)
    assert table.read().count() == 0
    batches = [[(f"k{(i + j) % 4}", i * j + 1) for j in range(3)] for i in range(50)]
    want, most = {}, 0
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "k string, n long").coalesce(1)
        if i == 26:  # cut off between the part, a merge over three levels, and the manifest
            with monkeypatch.context() as m:
                m.setattr(table, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    table.add(batch, i)
            assert {r["k"]: r["n"] for r in table.read().collect()} == want
        table.add(batch, i)
        if i % 10 == 0:
            table.add(batch, i)  # a repeated delivery
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        most = max(most, len(table.parts()))
    assert {r["k"]: r["n"] for r in table.read().collect()} == want
    assert most <= 2 * 4 and [(p.first, p.last) for p in table.parts()][0] == (0, 26)
    left = {p.name for p in (tmp_path / "t" / "parts").iterdir()}
    assert len(left) <= 2 * most and len(table._versions()) == 2  # what was merged is gone


def test_finished_runs_leave_the_table(spark, tmp_path):
    from attesta.streaming.levels import Levels

    columns = "run_id long, seq long, event string, done long, total long, cost_usd double"

    def steps(i):
        rows = [(r, i, "plan", i, 9, 0.5) for r in range(4)] + [(4, i, "done" if i else "plan", i, 9, 0.5)]
        return spark.createDataFrame(rows, columns)

    live_rows = ~F.col("_last.stage").eqNullSafe(F.lit("done"))
    table = Levels(spark, f"{tmp_path}/t", tables.table_schema(live.run_steps(steps(0))), live.merge_steps, live_rows, fan=2)
    for i in range(8):
        table.add(live.run_steps(steps(i)), i)
        assert (table.read().where("run_id = 4").count() == 0) == (i > 0)
    parts = table.parts()
    assert len(parts) == 1 and table._rows(parts).where("run_id = 4").count() == 0  # gone from the files too
    assert {(r["run_id"], r["done"]) for r in table.read().collect()} == {(r, 7) for r in range(4)}


def test_panes_make_sliding_windows(spark):
    rows = [(6000, "a", 1), (6000, "a", 1), (6300, "a", 1), (6300, "a", 2), (7800, "b", 1)]
    panes = spark.createDataFrame(rows, "s long, country string, user_id int").withColumn("pane_start", F.timestamp_seconds("s"))
    found = live.active_users(panes, ["country"]).select(F.unix_seconds("window_start").alias("w"), "country", "activeUsers").collect()
    want = {}
    for s, country, user in rows:
        for w in range(s - 1500, s + 1, 300):  # windows of half an hour that hold the pane
            want.setdefault((w, country), set()).add(user)
    assert {(r["w"], r["country"]): r["activeUsers"] for r in found} == {k: len(v) for k, v in want.items()}
    assert sorted((r["country"], r["activeUsers"]) for r in live.realtime(panes, ["country"]).collect()) == [("a", 2), ("b", 1)]


def test_reference_tables(spark, tmp_path):
    from attesta.sources import reference

    assert (reference.dim_platforms(spark).count(), reference.dim_reports(spark).count(), reference.dim_prices(spark).count()) == (18, 14, 11)
    (tmp_path / "s.json").write_text('{"key":"a","auth":"none"}\n{"key":"b","auth":"key_free","env_var":"K"}\n{"key":"c","auth":"key_free","env_var":"L"}\n')
    got = {r["key"]: r["status"] for r in reference.dim_sources(spark, str(tmp_path / "s.json"), ["K"]).collect()}
    assert got == {"a": "ready", "b": "ready", "c": "needs L"}
