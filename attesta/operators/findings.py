"""Findings: agent output to one adjudicated record per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import loose_json
from ..functions.text import field_type, is_blank, text_normal
from ..functions.urls import authority, url_normal
from .ordered import first_rows, row_position



# agent output ------------------------------------------------------------------


def parse_agent_output(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a JSON object in ``payload``, and the rows no repair could read."""
    parsed = df.withColumn("_json", loose_json.repaired(F.col(col))).withColumn(
        "payload", loose_json.as_object(F.col("_json"))
    )
    parsed = parsed.drop("_json")
    return (
        parsed.filter(F.col("payload").isNotNull()),
        parsed.filter(F.col("payload").isNull()).drop("payload"),
    )


def collect_findings(units: DataFrame, findings_key: str = "findings") -> DataFrame:
    """One row per finding of every unit that did not fail.

    The findings may be a list or one object. When the agreed key is absent, the
    first list of objects in the payload is taken, since the call has been paid for.
    """
    fields = loose_json.open_object(F.col("payload"))
    agreed = F.element_at(F.col("_fields"), findings_key)
    lists = F.filter(
        F.map_entries("_fields"),
        lambda e: ~e["key"].startswith("_") & F.coalesce(e["value"].rlike(r"^\s*\[\s*\{"), F.lit(False)),
    )
    chosen = (
        F.when(agreed.rlike(r"^\s*\["), agreed)
        .when(agreed.rlike(r"^\s*\{"), F.concat(F.lit("["), agreed, F.lit("]")))
        .otherwise(F.get(lists, F.lit(0))["value"])
    )
    items = F.from_json(chosen, "array<string>")
    kept = units.columns
    return (
        units.filter(is_blank(F.col("error")))
        .withColumn("_fields", fields)
        .select(*kept, F.posexplode(items).alias("_pos", "_item"))
        .filter(F.col("_item").startswith("{"))
        .withColumn("finding", loose_json.open_object(F.col("_item")))
        .withColumn("_agent", F.concat_ws("::", F.coalesce("target", F.lit("?")), F.coalesce("dimension", F.lit("?"))))
        .withColumnRenamed("target", "_target")
        .withColumnRenamed("dimension", "_dimension")
        .drop("payload", "error", "_item")
    )


def typed_findings(findings: DataFrame, contract: Sequence[str]) -> DataFrame:
    """The open finding map as the contract's columns; other fields stay in ``extra``."""
    known = F.array(*[F.lit(c) for c in contract])
    extra = F.map_filter("finding", lambda k, v: ~F.array_contains(known, k))
    return findings.select(
        "*", *[F.element_at("finding", c).alias(c) for c in contract], extra.alias("extra")
    ).drop("finding")


# merge --------------------------------------------------------------------------


def substantive(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def with_dedupe_key(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``_key``: the first of ``fields`` that still says something once normalised.

    The key is the digest of that form, so that it is cheap to shuffle. A finding with no
    usable field gets the digest of all its fields; none is lost. Each normal form is a
    column of its own and thus computed once. A table that already stores its ``_key`` is
    taken as it is.
    """
    if "_key" in df.columns:
        return df
    used = [f for f in fields if f in df.columns]
    forms = {
        f"_form{i}": url_normal(F.col(f)) if f in fixed.URL_KEY_FIELDS else text_normal(F.col(f))
        for i, f in enumerate(used)
    }
    whole = F.to_json(F.struct(*substantive(df)))
    first = F.coalesce(
        *[F.when(F.col(c) != "", F.col(c)) for c in forms], F.concat(F.lit("sha1:"), F.sha1(whole))
    )
    return (
        df.withColumns(forms)
        .withColumn("_first", first)
        .withColumn("_key", F.sha2("_first", 256))
        .drop("_first", *forms)
    )


def confidence_score(col: Column) -> Column:
    score = F.lit(0)
    for word, value in fixed.CONFIDENCE_SCORE.items():
        score = F.when(F.lower(col) == word, value).otherwise(score)
    return score


def filled_fields(df: DataFrame, fields: Sequence[str]) -> Column:
    filled = F.lit(0)
    for name in fields:
        filled = filled + F.when(is_blank(F.col(name), field_type(df, name)), 0).otherwise(1)
    return filled


def finding_sources(findings: DataFrame, dedupe_fields: Sequence[str] = fixed.DEDUPE_FIELDS) -> DataFrame:
    """Who reported what: one row per key and agent, with sightings and first arrival."""
    return (
        with_dedupe_key(findings, dedupe_fields)
        .select("_key", "_agent", "_ord")
        .filter(~is_blank(F.col("_agent")))
        .groupBy("_key", "_agent")
        .agg(F.count("*").alias("sightings"), F.min("_ord").alias("first_ord"))
    )


def merge_findings(
    findings: DataFrame,
    dedupe_fields: Sequence[str] = fixed.DEDUPE_FIELDS,
) -> DataFrame:
    """One record per entity: the richest sighting wins, its blanks filled from the others.

    Rank is confidence, then filled fields, then arrival (``_ord``, unique). Each
    column takes the best-ranked sighting that has a value. The findings are read once: a
    first aggregation by key and agent, which combines within the task, and a second by
    key over its results. ``_first_agent`` reported the entity first; the table of
    ``finding_sources`` has all agents.
    """
    fields = substantive(findings)
    ranked = with_dedupe_key(findings, dedupe_fields).withColumn(
        "_rank",
        F.struct(
            (-confidence_score(F.col("confidence"))).alias("confidence"),
            (-filled_fields(findings, fields)).alias("filled"),
            F.col("_ord").alias("ord"),
        ),
    )

    ranks = {c: F.when(~is_blank(F.col(c), field_type(findings, c)), F.col("_rank")) for c in fields}
    by_agent = ranked.groupBy("_key", "_agent").agg(
        F.count("*").alias("_n"),
        F.min("_ord").alias("_arrived"),
        *[F.min_by(c, rank).alias(c) for c, rank in ranks.items()],
        *[F.min(rank).alias(f"_rank_{c}") for c, rank in ranks.items()],
    )
    named = ~is_blank(F.col("_agent"))
    return by_agent.groupBy("_key").agg(
        F.sum("_n").alias("_corroborations"),
        *[F.min_by(c, f"_rank_{c}").alias(c) for c in fields],
        F.count_if(named).alias("_source_count"),
        F.min(F.when(named, F.col("_arrived"))).alias("_first_ord"),
        F.min_by("_agent", F.when(named, F.struct("_arrived", "_agent"))).alias("_first_agent"),
    )


def rank_findings(merged: DataFrame) -> DataFrame:
    """Most corroborated first, then most confident, with ``position`` over all of them."""
    order = [F.col("_corroborations").desc(), confidence_score(F.col("confidence")).desc(), F.col("_key")]
    return row_position(merged, [], order, "position")


def synthesis_order(findings: DataFrame, rows: int = fixed.SYNTHESIS_ROWS) -> DataFrame:
    """Supported first, then most corroborated: the report's top rows."""
    supported = F.coalesce(F.col("_verdict") == "supported", F.lit(False))
    return findings.orderBy(supported.desc(), F.col("_corroborations").desc(), F.col("_key")).limit(rows)


# votes ---------------------------------------------------------------------------


def majority_vote(
    votes: DataFrame, by: Sequence[str], answer: str, order: str, min_agreement: int = 2
) -> DataFrame:
    """Most common answer, its count, and whether enough voters agree; first seen wins a tie."""
    encoded = F.when(F.col(answer).isNotNull(), F.to_json(F.struct(answer)))
    counts = (
        votes.withColumn("_code", encoded)
        .groupBy(*by, "_code")
        .agg(
            F.count("_code").alias("_n"),
            F.min(order).alias("_first"),
            F.first(answer, ignorenulls=True).alias("_answer"),
        )
    )
    best = F.max_by(F.struct("_answer", "_n"), F.struct("_n", (-F.col("_first")).alias("first")))
    count = F.col("_best._n")
    return (
        counts.groupBy(*by)
        .agg(best.alias("_best"))
        .select(*by, F.col("_best._answer").alias(answer), count.alias("votes"), (count >= min_agreement).alias("agreed"))
    )


def adjudicate(
    findings: DataFrame,
    votes: DataFrame,
    key: str,
    lenses: int = len(fixed.VERIFIER_LENSES),
    max_problems: int | None = None,
) -> DataFrame:
    """Verdict of the lenses; a dead primary URL outweighs them.

    ``votes`` has ``key, lens, lens_ord, supported, problems``; a failed vote has a null
    ``supported``. ``findings`` may carry ``_url_status``. All problems stated are listed, or
    the first ``max_problems``.
    """
    need = max(1, lenses // 2 + 1)
    live = votes.filter(F.col("supported").isNotNull())
    tally = live.groupBy(key).agg(
        F.count_if("supported").alias("_yes"), F.count("*").alias("_live")
    )
    stated = live.select(key, "lens_ord", "lens", F.posexplode("problems").alias("_pos", "_problem"))
    order = ["lens_ord", "lens", "_pos"]
    if max_problems is not None:
        stated = first_rows(stated, [key], [F.col(c) for c in order], max_problems)
    problems = (
        stated.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(*order, "_problem"))).alias("_stated"))
        .select(key, F.col("_stated._problem").alias("_stated"))
    )
    judged = findings.join(tally, key, "left").join(problems, key, "left")
    status = F.col("_url_status") if "_url_status" in findings.columns else F.lit(None).cast("string")
    dead = F.coalesce(is_dead(status), F.lit(False))
    verdict = (
        F.when(dead, "refuted")
        .when(F.col("_live").isNull(), "unverified")
        .when(F.col("_yes") >= need, "supported")
        .otherwise("refuted")
    )
    stated_all = F.coalesce(F.col("_stated"), F.array().cast("array<string>"))
    reason = F.concat(F.lit("primary URL unreachable ("), status, F.lit(")"))
    return (
        judged.withColumn("_verdict", verdict)
        .withColumn(
            "_verdict_votes",
            F.when(F.col("_live").isNotNull(), F.concat_ws("/", F.col("_yes").cast("string"), F.col("_live").cast("string"))),
        )
        .withColumn("_problems", F.when(dead, F.concat(F.array(reason), stated_all)).otherwise(stated_all))
        .drop("_yes", "_live", "_stated")
    )


# cited URLs ----------------------------------------------------------------------


def is_dead(status: Column) -> Column:
    return status.startswith("dead") | (status == "invalid")


def _citations(findings: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per cited http URL: key, field label, rank of the field, url."""
    parts = []
    for rank, name in enumerate(fields):
        if name not in findings.columns:
            continue
        if field_type(findings, name).typeName() == "array":
            part = F.transform(
                F.col(name),
                lambda u, i: F.struct(
                    F.concat(F.lit(name + "["), i.cast("string"), F.lit("]")).alias("field"),
                    F.lit(rank).alias("rank"),
                    u.alias("url"),
                ),
            )
        else:
            part = F.array(F.struct(F.lit(name).alias("field"), F.lit(rank).alias("rank"), F.col(name).alias("url")))
        parts.append(F.coalesce(part, F.array().cast("array<struct<field:string,rank:int,url:string>>")))
    cited = findings.select(key, F.explode(F.concat(*parts)).alias("_c")).select(key, "_c.*")
    return cited.filter(F.col("url").startswith("http"))


def cited_urls(findings: DataFrame, key: str = "_key", fields: Sequence[str] = fixed.URL_FIELDS) -> DataFrame:
    """Every URL any finding cites, once."""
    return _citations(findings, key, fields).select("url").distinct()


def attach_url_status(
    findings: DataFrame, liveness: DataFrame, key: str = "_key", fields: Sequence[str] = fixed.URL_FIELDS
) -> DataFrame:
    """Status of each cited URL back on its finding; the first field's status leads.

    ``liveness`` has one row per URL. Only key, field and URL travel to that join, and a
    URL cited by very many findings is split by the adaptive skew join.
    """
    per_finding = (
        _citations(findings, key, fields)
        .join(liveness.select("url", F.col("status").alias("_status")), "url")
        .groupBy(key)
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "_status")))).alias("_url_checks"),
            F.min_by("_status", F.struct("rank", "field")).alias("_url_status"),
        )
    )
    return findings.join(per_finding, key, "left")


def liveness_summary(liveness: DataFrame) -> DataFrame:
    """URLs checked and dead, per host and in total (host null)."""
    return (
        liveness.withColumn("host", authority(F.col("url")))
        .rollup("host")
        .agg(F.count("*").alias("checked"), F.count_if(is_dead(F.col("status"))).alias("dead"))
    )


# run tables -----------------------------------------------------------------------


def coverage_gaps(units: DataFrame) -> DataFrame:
    """What agents looked for and did not find."""
    return units.filter(~is_blank(F.col("gaps"))).select(
        F.concat(F.lit("[gap] "), F.coalesce("target", F.lit("?"))).alias("name"),
        F.col("gaps").alias("summary"),
        F.concat_ws("::", "target", "dimension").alias("_agent"),
    )


def run_stats(
    planned: DataFrame, units: DataFrame, raw: DataFrame, merged: DataFrame, calls: DataFrame | None = None, steps: DataFrame | None = None
) -> DataFrame:
    """The run's counters: each input is reduced to a row of counts, and the rows laid over each other.

    ``calls`` with their ``outcome`` tell whether the budget ended the run, ``steps`` with
    ``started_s`` and ``finished_s`` how long it took.
    """
    resumed = planned.join(units.filter(is_blank(F.col("error"))), "unit_key", "left_semi")
    failed = ~is_blank(F.col("error"))
    parts = [
        planned.agg(
            F.count_distinct("target").alias("targets"),
            F.count_distinct("dimension").alias("dimensions"),
            F.count("*").alias("units_total"),
        ),
        units.agg(F.count_if(~failed).alias("units_completed"), F.count_if(failed).alias("units_failed")),
        resumed.agg(F.count("*").alias("units_resumed")),
        raw.agg(F.count("*").alias("findings_raw")),
        merged.agg(
            F.count("*").alias("findings_unique"),
            F.count_if(F.col("_verdict") == "supported").alias("findings_verified"),
            F.count_if(F.col("_verdict") == "refuted").alias("findings_refuted"),
            F.count_if(is_dead(F.col("_url_status"))).alias("urls_dead"),
        ),
    ]
    if calls is not None:
        parts.append(calls.agg(F.coalesce(F.bool_or(F.col("outcome") == "blocked"), F.lit(False)).alias("aborted")))
    if steps is not None:
        parts.append(steps.agg(F.round((F.max("finished_s") - F.min("started_s")).cast("double"), 1).alias("elapsed_s")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def sections(
    findings: DataFrame, gaps: DataFrame | None = None, refuted: bool = True, unverified: bool = True
) -> DataFrame:
    """Findings labelled by the report section their verdict puts them in."""
    names = fixed.SECTION_BY_VERDICT
    section = (
        F.when(F.col("_verdict") == "supported", names["supported"])
        .when(F.col("_verdict") == "refuted", names["refuted"])
        .otherwise(names["other"])
    )
    out = findings.withColumn("section", section)
    if not refuted:
        out = out.filter(F.col("section") != names["refuted"])
    if not unverified:
        out = out.filter(F.col("section") != names["other"])
    if gaps is not None:
        out = out.unionByName(gaps.withColumn("section", F.lit(names["gap"])), allowMissingColumns=True)
    return out


def top_per_section(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """A report's first ``n`` rows per section, each with the number of rows left out."""
    totals = rows.groupBy("section").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("omitted"))
    return first_rows(rows, ["section"], order, n, rank="position").join(totals, "section")
