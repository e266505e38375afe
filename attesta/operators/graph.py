"""Knowledge graph: tables derived from an append-only observation log, and questions on them.

An observation is ``source, source_kind, predicate, target, target_kind, confidence,
run_id, agent, source_url, snippet, captured_at`` and, where order matters beyond time,
``ord``. Deriving the tables again gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .. import fixed_values as fixed
from ..functions.text import entity_key, is_blank, predicate_name
from ..functions.urls import domain
from ..session import cut_lineage
from .findings import _citations

# build ----------------------------------------------------------------------------


def add_keys(observations: DataFrame) -> DataFrame:
    """Canonical keys of both ends and the canonical predicate."""
    return observations.select(
        "*",
        entity_key(F.col("source"), F.col("source_kind")).alias("source_key"),
        predicate_name(F.col("predicate")).alias("relation"),
        entity_key(F.col("target"), F.col("target_kind")).alias("target_key"),
    )


def build_relations(observations: DataFrame) -> DataFrame:
    """One edge per source, predicate and target; its weight is how often it was seen.

    Equal spellings are counted before their keys are computed.
    """
    spelled = observations.groupBy("source", "source_kind", "predicate", "target", "target_kind").agg(*_edge_values(F.count("*"), "captured_at"))
    return relations_of(add_keys(spelled), F.sum("weight"), "first_seen", F.max("_last"))


def _edge_values(weight: Column, seen: str, last: Column | None = None) -> list[Column]:
    last = F.max(F.struct("captured_at", "ord", "confidence")) if last is None else last
    return [weight.alias("weight"), F.min(seen).alias("first_seen"), last.alias("_last")]


def relations_of(keyed: DataFrame, weight: Column | None = None, seen: str = "captured_at", last: Column | None = None) -> DataFrame:
    """Edges of observations that have their keys."""
    values = _edge_values(F.count("*") if weight is None else weight, seen, last)
    return keyed.groupBy("source_key", "relation", "target_key").agg(*values).select(
        "source_key", F.col("relation").alias("predicate"), "target_key", "weight", F.col("_last.confidence").alias("confidence"),
        "first_seen", F.col("_last.captured_at").alias("last_seen"),
    )


def relation_attrs(observations: DataFrame) -> DataFrame:
    """Attributes of edges, one row each; the last value that says something wins.

    Equal spellings are reduced to their last value before their keys are computed.
    """
    spelling = ["source", "source_kind", "predicate", "target", "target_kind"]
    stated = observations.select(*spelling, F.explode("attrs").alias("attr", "value"), "captured_at", "ord")
    last = F.max(F.struct("captured_at", "ord", "value")).alias("_last")
    spelled = stated.filter(~is_blank(F.col("value"))).groupBy(*spelling, "attr").agg(last)
    edges = add_keys(spelled).groupBy("source_key", F.col("relation").alias("predicate"), "target_key", "attr")
    return edges.agg(F.max("_last").alias("_last")).select("source_key", "predicate", "target_key", "attr", F.col("_last.value").alias("value"))


def end_mentions(observations: DataFrame) -> DataFrame:
    """Both ends of every observation as mentions of entities."""
    ends = F.array(
        F.struct(F.col("source").alias("name"), F.col("source_kind").alias("kind")),
        F.struct(F.col("target").alias("name"), F.col("target_kind").alias("kind")),
    )
    return observations.select(F.explode(ends).alias("_e"), F.col("captured_at").alias("seen_at"), "ord").select(
        "_e.*", "seen_at", "ord", F.lit(False).alias("direct")
    )


def build_entities(mentions: DataFrame) -> DataFrame:
    """Mentions ``name, kind, seen_at, ord, direct`` to one entity per canonical key.

    The longest spelling is its display name. Mentions of its own and as the end of an
    edge are counted apart. Equal spellings are counted before they are normalised.
    """
    spelled = (
        mentions.filter(~is_blank(F.trim("name")))
        .groupBy(F.trim("name").alias("name"), "kind")
        .agg(
            F.count_if("direct").alias("_direct"),
            F.count_if(~F.col("direct")).alias("_ends"),
            F.min("seen_at").alias("_first"),
            F.max("seen_at").alias("_last"),
            F.min("ord").alias("_ord"),
        )
    )
    return (
        spelled.withColumn("entity_key", entity_key(F.col("name"), F.col("kind")))
        .groupBy("entity_key")
        .agg(
            F.max_by("name", F.struct(F.length("name"), -F.col("_ord"), "name")).alias("name"),
            F.first("kind").alias("kind"),
            F.sum("_direct").alias("mentions"),
            F.sum("_ends").alias("edge_mentions"),
            F.min("_first").alias("first_seen"),
            F.max("_last").alias("last_seen"),
        )
    )


def entity_attrs(mentions: DataFrame) -> DataFrame:
    """Attributes of entities, one row each; the first value that says something stays."""
    stated = mentions.select(
        entity_key(F.col("name"), F.col("kind")).alias("entity_key"), "seen_at", "ord", F.explode("attrs").alias("attr", "value")
    )
    return (
        stated.filter(~is_blank(F.col("value")))
        .groupBy("entity_key", "attr")
        .agg(F.min_by("value", F.struct("seen_at", "ord", "value")).alias("value"))
    )


def build_aliases(mentions: DataFrame) -> DataFrame:
    """Every name an entity goes by."""
    names = F.array(F.col("name"))
    if "aliases" in mentions.columns:
        names = F.concat(names, F.coalesce("aliases", F.array().cast("array<string>")))
    spelled = mentions.select("name", "kind", F.explode(names).alias("_alias")).select(
        "name", "kind", F.trim("_alias").alias("alias")
    )
    return (
        spelled.filter(~is_blank(F.col("alias")))
        .distinct()
        .select(entity_key(F.col("name"), F.col("kind")).alias("entity_key"), "alias")
        .distinct()
    )


def build_sources(fetches: DataFrame) -> DataFrame:
    """Last state of every cited page; a title once known is not lost to a later blank."""
    when = F.struct("fetched_at", "ord")
    return (
        fetches.groupBy("url")
        .agg(
            F.max_by(F.struct("run_id", "content_hash", "status", "fetched_at"), when).alias("_last"),
            F.max_by("title", F.when(F.col("title").isNotNull(), when)).alias("title"),
        )
        .select("url", "title", "_last.*")
    )


def cited_sources(findings: DataFrame, key: str = "_key") -> DataFrame:
    """Pages the findings cite, titled by the first finding that cites them."""
    cited = _citations(findings, key, ("url", "website", "source_url", "linkedin"))
    named = findings.select(key, "name", "_ord", "_url_status")
    order = F.struct("_ord", "rank")
    return (
        cited.join(named, key)
        .groupBy("url")
        .agg(F.min_by("name", order).alias("title"), F.min_by("_url_status", order).alias("status"))
    )


# ingest -----------------------------------------------------------------------------


def infer_kind(findings: DataFrame) -> Column:
    """What sort of thing a finding names, from its category and the fields it has."""
    have = set(findings.columns)

    def field(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    category = F.lower(F.coalesce(field("category"), F.lit("")))
    company = F.lit(False)
    for name in ("linkedin", "website", "approx_size", "founded_year", "hq_city"):
        company = company | ~is_blank(field(name))
    return (
        F.when(category.rlike("people|person|founder|exec"), "person")
        .when(category.rlike("product|tool|platform"), "product")
        .when(company | category.contains("vendor"), "company")
        .when(field("value").isNotNull() & ~is_blank(field("period")), "statistic")
        .otherwise("thing")
    )


def finding_edges(findings: DataFrame, topic: str, run_id: str) -> DataFrame:
    """Observations a run's merged findings make: found, field edges, and where documented.

    Refuted findings stay, with low confidence and their verdict: a claim that did not hold
    is knowledge. What says nothing is no attribute.
    """
    have = set(findings.columns)

    def field(name: str) -> Column:
        return F.trim(F.col(name)) if name in have else F.lit(None).cast("string")

    name, kind, none = F.col("_name"), F.col("_kind"), F.lit(None).cast("string")
    no_attrs = F.lit(None).cast("map<string,string>")

    def edge(source: Column, source_kind: Column, predicate: str, target: Column, target_kind: Column, snippet: Column, attrs: Column = no_attrs) -> Column:
        return F.struct(
            source.alias("source"), source_kind.alias("source_kind"), F.lit(predicate).alias("predicate"),
            target.alias("target"), target_kind.alias("target_kind"), snippet.alias("snippet"), attrs.alias("attrs"),
        )

    def stated(**values: Column) -> Column:
        pairs = F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in values.items()))
        return F.map_from_entries(F.filter(pairs, lambda p: ~is_blank(p["value"])))

    snippet = F.coalesce(field("summary"), field("evidence"))
    edges = [edge(F.lit(topic), F.lit("topic"), "found", name, kind, snippet, stated(verdict=field("_verdict"), url=F.col("_url")))]
    for field_name, predicate, target_kind in fixed.FIELD_EDGES:
        if field_name in have:
            value = field(field_name)
            edges.append(F.when(~is_blank(value), edge(name, kind, predicate, value, F.lit(target_kind), none)))
    host = domain(F.col("_url"))
    edges.append(F.when(~is_blank(host), edge(name, kind, "documented_at", host, F.lit("domain"), none, stated(url=F.col("_url"), status=field("_url_status")))))
    own = F.coalesce(field("confidence"), F.lit("medium"))
    confidence = F.when(F.col("_verdict") == "supported", "high").when(F.col("_verdict") == "refuted", "low").otherwise(own)
    return (
        findings.withColumn("_name", F.coalesce(field("name"), field("title")))
        .filter(~is_blank(F.col("_name")))
        .withColumn("_url", F.coalesce(field("url"), field("website"), F.lit("")))
        .withColumn("_kind", infer_kind(findings))
        .withColumn("_conf", confidence)
        .select(F.explode(F.array_compact(F.array(*edges))).alias("_e"), "_conf", "_url", field("_verdict").alias("verdict"), "_agent", "_ord")
        .select(
            "_e.*",
            F.col("_conf").alias("confidence"),
            "verdict",
            F.lit(run_id).alias("run_id"),
            F.col("_agent").alias("agent"),
            F.col("_url").alias("source_url"),
            F.col("_ord").alias("ord"),
        )
    )


def finding_entities(findings: DataFrame, seen_at: Column) -> DataFrame:
    """The entities that findings name, as mentions with attributes and further names.

    Every plain column that says something is an attribute, but for the name, the title and
    the columns of the run itself, which begin with an underscore.
    """
    have = set(findings.columns)
    name = F.trim(F.coalesce(*(F.col(c) for c in ("name", "title") if c in have)))
    plain = [
        f.name for f in findings.schema.fields
        if not f.name.startswith("_") and f.name not in ("name", "title") and isinstance(f.dataType, AtomicType)
    ]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in plain))
    others = F.array(*(F.col(c).cast("string") for c in ("aka", "legal_name") if c in have)).cast("array<string>")
    return findings.filter(~is_blank(name)).select(
        name.alias("name"), infer_kind(findings).alias("kind"), seen_at.alias("seen_at"), F.col("_ord").alias("ord"), F.lit(True).alias("direct"),
        F.map_from_entries(F.filter(pairs, lambda p: ~is_blank(p["value"]))).alias("attrs"),
        F.filter(others, lambda a: ~is_blank(a)).alias("aliases"),
    )


def researched_edges(targets: DataFrame, topic: str, run_id: str) -> DataFrame:
    """The topic entity and what it was researched for."""
    return targets.filter(~is_blank(F.col("label"))).select(
        F.lit(topic).alias("source"), F.lit("topic").alias("source_kind"), F.lit("researched").alias("predicate"),
        F.col("label").alias("target"), F.lit("subject").alias("target_kind"), F.lit("high").alias("confidence"),
        F.lit(run_id).alias("run_id"),
    )


def prose_edges(relations: DataFrame, types: DataFrame, run_id: str) -> DataFrame:
    """Observations from relations already extracted from prose; blank and self relations go."""
    src, dst = F.trim("source"), F.trim("target")
    kept = relations.withColumn("source", src).withColumn("target", dst).filter(
        ~is_blank(F.col("source")) & ~is_blank(F.col("target")) & ~is_blank(F.trim("predicate"))
        & (F.lower("source") != F.lower("target"))
    )
    known = types.groupBy("name").agg(F.coalesce(F.min("type"), F.lit("thing")).alias("_type"))
    with_source = kept.join(known.withColumnsRenamed({"name": "source", "_type": "source_kind"}), "source", "left")
    with_both = with_source.join(known.withColumnsRenamed({"name": "target", "_type": "target_kind"}), "target", "left")
    return with_both.withColumns(
        {
            "source_kind": F.coalesce("source_kind", F.lit("thing")),
            "target_kind": F.coalesce("target_kind", F.lit("thing")),
            "confidence": F.lit("medium"),
            "run_id": F.lit(run_id),
            "agent": F.lit("graph-extract"),
        }
    )


# questions ------------------------------------------------------------------------------


def get_entity(entities: DataFrame, name: str, kind: str) -> DataFrame:
    return entities.filter(F.col("entity_key") == entity_key(F.lit(name), F.lit(kind)))


def search_entities(entities: DataFrame, aliases: DataFrame, query: str, limit: int = fixed.SEARCH_ROWS) -> DataFrame:
    """Entities whose names hold every word of the query; failing any, those that contain it."""
    words = sorted({w for w in query.lower().split() if w})
    names = entities.select("entity_key", F.col("name").alias("alias")).unionByName(aliases)
    tokens = F.split(F.lower("alias"), "[^\\p{L}\\p{N}]+")
    every = F.lit(bool(words))
    for word in words:
        every = every & F.max(F.array_contains("_tokens", word))
    part = F.max(F.contains(F.lower("alias"), F.lit(query.lower())))
    matched = names.withColumn("_tokens", tokens).groupBy("entity_key").agg(every.alias("_every"), part.alias("_part"))
    by_word = matched.filter("_every")
    hits = matched.filter(F.col("_every") | (F.col("_part") & ~by_word.exists()))
    found = entities.join(hits, "entity_key", "left_semi")
    return found.orderBy(F.col("mentions").desc(), F.col("entity_key")).limit(limit)


def top_entities(entities: DataFrame, kind: str | None = None, limit: int = 50, by: str = "mentions") -> DataFrame:
    rows = entities if kind is None else entities.filter(F.col("kind") == kind)
    return rows.orderBy(F.col(by).desc(), F.col("last_seen").desc(), F.col("entity_key")).limit(limit)


def top_edges(relations: DataFrame, predicate: str | None = None, limit: int = 1000) -> DataFrame:
    rows = relations if predicate is None else relations.filter(F.col("predicate") == predicate)
    return rows.orderBy(F.col("weight").desc(), "source_key", "predicate", "target_key").limit(limit)


def with_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names and kinds of both ends; an end without an entity has nulls, as has an edge without a whole key."""
    about = entities.groupBy("entity_key").agg(F.max(F.struct("name", "kind")).alias("_about"))
    whole = F.col("source_key").isNotNull() & F.col("predicate").isNotNull() & F.col("target_key").isNotNull()
    named = edges
    for end in ("source", "target"):
        met = about.select(F.col("entity_key").alias(f"_{end}_at"), F.col("_about").alias(f"_{end}"))
        named = named.join(met, (F.col(f"{end}_key") == F.col(f"_{end}_at")) & whole, "left")
    return named.select(
        *edges.columns,
        F.col("_source.name").alias("source_name"), F.col("_source.kind").alias("source_kind"),
        F.col("_target.name").alias("target_name"), F.col("_target.kind").alias("target_kind"),
    )


def neighbors(relations: DataFrame, start: str, depth: int = 1, limit: int | None = None) -> DataFrame:
    """Edges within ``depth`` hops of an entity key: all of them, or the strongest ``limit`` of each hop.

    Every hop is written out to cut the plan; which side of a join is broadcast is left to Spark.
    """
    spark = relations.sparkSession
    frontier = spark.range(1).select(F.lit(start).alias("node"))
    seen = frontier
    found = None
    ends = [F.col("source_key"), F.col("target_key")]
    for hop in range(1, max(1, depth) + 1):
        forward = relations.join(frontier, ends[0] == F.col("node"), "left_semi")
        backward = relations.join(frontier, ends[1] == F.col("node"), "left_semi")
        touched = forward.unionByName(backward).dropDuplicates(["source_key", "predicate", "target_key"])
        if limit is not None:
            touched = touched.orderBy(F.col("weight").desc(), "source_key", "predicate", "target_key").limit(limit)
        touched = touched.withColumn("hop", F.lit(hop))
        if depth > 1:
            touched = cut_lineage(touched)
        found = touched if found is None else found.unionByName(touched)
        if hop < depth:
            nodes = touched.select(F.explode(F.array(*ends)).alias("node")).distinct()
            frontier = nodes.join(seen, "node", "left_anti")
            seen = seen.unionByName(frontier)
    return found.groupBy("source_key", "predicate", "target_key").agg(
        F.first("weight").alias("weight"), F.first("confidence").alias("confidence"), F.min("hop").alias("hop")
    )


def provenance(observations: DataFrame, entity: str, limit: int = fixed.PROVENANCE_ROWS) -> DataFrame:
    """Who says so: the newest observations with the entity at either end."""
    keyed = add_keys(observations)
    about = keyed.filter((F.col("source_key") == entity) | (F.col("target_key") == entity))
    return about.orderBy(F.col("captured_at").desc(), F.col("ord").desc(), F.col("source_url")).limit(limit)


def graph_stats(entities: DataFrame, relations: DataFrame, observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Sizes of the tables, entities by kind and the most frequent predicates, as rows."""

    by_kind = _with_total(entities, "kind", "kind", "entities")
    by_predicate = _with_total(relations, "predicate", "predicate", "relations")
    totals = by_predicate.filter(F.col("statistic") == "total")
    top = by_predicate.filter(F.col("statistic") == "predicate")
    log = observations.agg(F.count("*").alias("observations"), F.count_distinct("run_id").alias("runs"))
    pages = sources.agg(F.count("*").alias("sources"))
    return by_kind.unionByName(totals).unionByName(top).unionByName(_as_rows(log)).unionByName(_as_rows(pages))


def _with_total(df: DataFrame, by: str, statistic: str, total: str) -> DataFrame:
    """Rows per value of a column and in total, from one pass."""
    counted = df.rollup(by).agg(F.count("*").alias("value"), F.grouping_id().alias("_level"))
    is_total = F.col("_level") == 1
    return counted.select(
        F.when(is_total, "total").otherwise(statistic).alias("statistic"),
        F.when(is_total, total).otherwise(F.col(by)).alias("name"),
        "value",
    )


def _as_rows(totals: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit("total").alias("statistic"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in totals.columns])
    return totals.select(F.inline(pairs))
