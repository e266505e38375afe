import datetime as dt

from attesta.functions.text import entity_key
from attesta.operators import graph as ops
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
OBS = "source string, source_kind string, predicate string, target string, target_kind string, confidence string, run_id string, agent string, source_url string, snippet string, captured_at timestamp, ord long, attrs map<string,string>"


def observations(spark, edges):
    rows = [
        (s, "company", p, d, "company", c, "r", "a", "u", "x", T0 + dt.timedelta(days=i), i, a) for i, (s, p, d, c, a) in enumerate(edges)
    ]
    return spark.createDataFrame(rows, OBS)


def test_keys(spark):
    names = [("Scale AI, Inc.",), ("scale ai",), ("Café Société",), ("The Group",), ("日本",), ("中国",), ("",)]
    got = [r[0] for r in spark.createDataFrame(names, "n string").select(entity_key(F.col("n"), F.lit("c"))).collect()]
    assert got[:4] == ["c:scale-ai", "c:scale-ai", "c:cafe-societe", "c:the-group"]
    assert got[4].startswith("c:x-") and got[4] != got[5] and got[6] == "c:unknown"


def test_relation_weight_confidence_and_attrs(spark):
    obs = observations(spark, [("A", "Owns  It", "B", "low", {"k": "1"}), ("A", "owns it", "B Inc.", "high", {"k": ""}), ("a", "owns it", "B", "medium", {"k": "2", "z": None})])
    row = ops.build_relations(obs).head()
    assert (row["predicate"], row["weight"], row["confidence"]) == ("owns_it", 3, "medium")
    assert [(r["attr"], r["value"]) for r in ops.relation_attrs(obs).collect()] == [("k", "2")]


def test_entities(spark):
    rows = [
        ("Acme", "company", {"founded": "1999", "hq": ""}, None, T0, 1, True),
        ("Acme Inc.", "company", {"founded": None, "industry": "x", "hq": "Bonn"}, ["ACME GmbH"], T0, 2, True),
    ]
    m = spark.createDataFrame(rows, "name string, kind string, attrs map<string,string>, aliases array<string>, seen_at timestamp, ord long, direct boolean")
    got = ops.build_entities(m).head()
    assert (got["entity_key"], got["name"], got["mentions"], got["edge_mentions"]) == ("company:acme", "Acme Inc.", 2, 0)
    assert {(r["attr"], r["value"]) for r in ops.entity_attrs(m).collect()} == {("founded", "1999"), ("industry", "x"), ("hq", "Bonn")}
    assert {r["alias"] for r in ops.build_aliases(m).collect()} == {"Acme", "Acme Inc.", "ACME GmbH"}


def test_neighbors_by_depth(spark):
    rel = ops.build_relations(observations(spark, [("A", "p", "B", "low", None), ("B", "p", "C", "low", None), ("C", "p", "D", "low", None)]))
    for limit in (200, None):
        assert ops.neighbors(rel, "company:a", 1, limit).count() == 1
        assert ops.neighbors(rel, "company:b", 1, limit).count() == 2
        assert ops.neighbors(rel, "company:a", 2, limit).count() == 2
        assert ops.neighbors(rel, "company:a", 3, limit).count() == 3
    assert ops.neighbors(rel, "company:none", 2).count() == 0


def test_the_second_hop_survives_a_full_first_hop(spark):
    spokes = [("Hub", "p", f"Spoke {i}", "low", None) for i in range(300)]
    rel = ops.build_relations(observations(spark, [*spokes, ("Spoke 7", "q", "Far", "low", None)]))
    by_hop = {r["hop"]: r["count"] for r in ops.neighbors(rel, "company:hub", 2).groupBy("hop").count().collect()}
    assert by_hop == {1: 300, 2: 1}


def test_long_predicates_stay_apart(spark):
    long = "is a member of the standing committee on the preservation of "
    rel = ops.build_relations(observations(spark, [("A", long + "mills", "B", "low", None), ("A", long + "barns", "B", "low", None)]))
    assert rel.count() == 2


def test_search_by_alias_and_fallback(spark):
    m = spark.createDataFrame([("International Business Machines", "company", ["IBM"], T0, 1, True), ("Ibmex", "company", None, T0, 2, True)], "name string, kind string, aliases array<string>, seen_at timestamp, ord long, direct boolean")
    entities, aliases = ops.build_entities(m), ops.build_aliases(m)
    assert [r["name"] for r in ops.search_entities(entities, aliases, "ibm").collect()] == ["International Business Machines"]
    assert [r["name"] for r in ops.search_entities(entities, aliases, "machines business").collect()] == ["International Business Machines"]
    assert [r["name"] for r in ops.search_entities(entities, aliases, "bme").collect()] == ["Ibmex"]


def test_provenance_from_either_end(spark):
    obs = observations(spark, [("A", "p", "B", "low", None), ("C", "p", "A", "low", None), ("C", "p", "B", "low", None)])
    assert ops.provenance(obs, "company:a").count() == 2


def test_finding_edges(spark):
    f = spark.createDataFrame([("Acme", "https://www.acme.com/x", "Berlin", "people", "refuted", "high", "sum", "ag", 1)], "name string, url string, country string, category string, _verdict string, confidence string, summary string, _agent string, _ord long")
    got = {(r["source"], r["predicate"], r["target"], r["target_kind"], r["confidence"]) for r in ops.finding_edges(f, "topic", "r").collect()}
    assert got == {
        ("topic", "found", "Acme", "person", "low"), ("Acme", "located_in", "Berlin", "place", "low"),
        ("Acme", "categorised_as", "people", "category", "low"), ("Acme", "documented_at", "acme.com", "domain", "low"),
    }


def test_findings_enter_the_graph_whole(spark):
    rows = [("Acme", "https://acme.com", 1999, None, "", "supported", "dead_404", "Acme Ltd", "a", 1, [1]), (" ", "u", 1, "x", "y", None, None, None, "a", 2, None)]
    f = spark.createDataFrame(rows, "name string, url string, founded_year int, country string, sector string, _verdict string, _url_status string, aka string, _agent string, _ord long, parts array<int>")
    got = ops.finding_entities(f, F.lit("2024-01-01").cast("timestamp"))
    (one,) = got.collect()
    assert (one.name, one.kind, one.attrs, one.aliases) == ("Acme", "company", {"url": "https://acme.com", "founded_year": "1999", "aka": "Acme Ltd"}, ["Acme Ltd"])
    assert {r.alias for r in ops.build_aliases(got).collect()} == {"Acme", "Acme Ltd"}
    edges = {r.predicate: (r.verdict, r.attrs) for r in ops.finding_edges(f, "t", "r").collect()}
    assert edges == {
        "found": ("supported", {"verdict": "supported", "url": "https://acme.com"}),
        "documented_at": ("supported", {"url": "https://acme.com", "status": "dead_404"}),
    }
    assert ops.finding_entities(f.limit(0), F.current_timestamp()).count() == 0


def test_edges_name_both_ends(spark):
    edges = spark.createDataFrame([("c:a", "p", "c:b", 2), ("c:a", "p", "c:a", 1), ("c:x", "q", "c:a", 1)], "source_key string, predicate string, target_key string, weight int")
    entities = spark.createDataFrame([("c:a", "A", "company"), ("c:b", "B", "place")], "entity_key string, name string, kind string")
    got = sorted(ops.with_ends(edges, entities).collect())
    assert [tuple(r)[4:] for r in got] == [("A", "company", "A", "company"), ("A", "company", "B", "place"), (None, None, "A", "company")]
    assert ops.with_ends(edges.limit(0), entities).count() == 0


def test_topics_point_at_what_they_were_researched_for(spark):
    targets = spark.createDataFrame([("k1", "Reed beds"), ("k2", ""), ("k3", None)], "key string, label string")
    got = ops.researched_edges(targets, "Wetlands", "run-7").collect()
    assert [(r.source, r.source_kind, r.predicate, r.target, r.target_kind, r.confidence, r.run_id) for r in got] == [
        ("Wetlands", "topic", "researched", "Reed beds", "subject", "high", "run-7")
    ]


def test_letters_of_ligatures_stay(spark):
    from attesta.functions.text import entity_slug, fold_accents

    df = spark.createDataFrame([("ﬁntech Labs",), ("Œuvre ½",), ("ﬃ ﬆ Ⅷ ㎏ ①",), ("Ａｃｍｅ 𝐁𝐨𝐥𝐝",), ("Café",), ("語彙",), (None,), ("plain",)], "n string")
    got = [r["f"] for r in df.select(fold_accents(F.col("n")).alias("f")).collect()]
    assert got == ["fintech Labs", "Œuvre 12", "ffi st VIII kg 1", "Acme Bold", "Cafe", "語彙", None, "plain"]
    assert df.select(entity_slug(F.col("n")).alias("s")).head()["s"] == df.limit(1).select(entity_slug(F.lit("fintech Labs")).alias("s")).head()["s"]


def _log(spark):
    rows = [(f"Acme {i % 5}", "company", "Makes", "Widget GmbH" if i % 2 else f"Acme {i % 5}", "company", "high", "r1", "a", f"u{i}", None, i) for i in range(40)]
    names = "source string, source_kind string, predicate string, target string, target_kind string, confidence string, run_id string, agent string, source_url string, snippet string, ord long"
    return spark.createDataFrame(rows, names).withColumn("captured_at", F.timestamp_seconds("ord"))


def test_stored_graph_reads_only_its_buckets(spark, tmp_path):
    from attesta.operators.graph_store import GraphStore

    log = _log(spark)
    direct = spark.createDataFrame([("Acme 1", "company", {"city": "Bonn am Rhein"}, 1), ("Acme 1", "company", None, 2), ("Ümlaut", "company", {"city": "Köln"}, 3)], "name string, kind string, attrs map<string,string>, ord long")
    direct = direct.select("name", "kind", F.timestamp_seconds("ord").alias("seen_at"), "ord", F.lit(True).alias("direct"), "attrs")
    ends = ops.end_mentions(log).withColumn("attrs", F.lit(None).cast("map<string,string>"))
    store = GraphStore.build(log, ends.unionByName(direct), str(tmp_path))
    for entity in ("company:acme-1", "company:widget", "company:none"):
        want = ops.provenance(log, entity).select("source_url", "captured_at").collect()
        found = store.provenance(entity)
        assert found.select("source_url", "captured_at").collect() == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and "UDF" not in plan and "regexp" not in plan
    lookup = store.entity("the ACME 1, Inc.", "company")
    assert [(r["entity_key"], r["mentions"]) for r in lookup.collect()] == [("company:acme-1", 2)]
    assert "PartitionFilters: [(bucket" in (p := lookup._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [isnotnull(bucket" in p
    keys = lambda q: [r["entity_key"] for r in store.search(q).collect()]
    assert keys("acme")[0] == "company:acme-1" and len(keys("acme")) == 5
    assert keys("acme 3") == ["company:acme-3"] and keys("bonn RHEIN") == ["company:acme-1"] and keys("köln") == ["company:umlaut"]
    assert keys("idget G") == ["company:widget"] and keys("nn am rh") == ["company:acme-1"]
    assert keys("") == keys("zz") == keys("nowhere at all") == []
    assert store.relations().count() == ops.build_relations(log).count()


def test_a_table_is_stored_when_a_question_needs_it(spark, tmp_path):
    from attesta.operators.graph_store import TABLES, GraphStore

    log = _log(spark)
    ends = ops.end_mentions(log).withColumn("attrs", F.lit(None).cast("map<string,string>"))
    store = GraphStore.of(log, ends, str(tmp_path))
    there = lambda: {n for n in TABLES if (tmp_path / n).exists()}
    assert there() == set()
    assert store.entity("Acme 1", "company").count() == 1 and there() == {"entities"}
    assert [r["entity_key"] for r in store.search("widget").collect()] == ["company:widget"] and there() == {"entities", "postings/kind=word"}
    for entity in ("company:acme-3", "company:widget", "company:none"):
        assert store.provenance(entity, 5).collect() == ops.provenance(log, entity, 5).select(*store.provenance(entity, 5).columns).collect()
    assert "source" not in store.table("targets").columns  # by target only keys and order, not the rows once more
    assert GraphStore.build(log, ends, str(tmp_path)).relations().count() and there() == set(TABLES)
