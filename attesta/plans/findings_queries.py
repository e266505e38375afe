"""Findings, runs and cost: registered queries and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_key, slug
from ..functions.urls import authority, url_kind, url_normal
from ..operators import findings as ops
from ..operators import pages as page_ops
from ..operators import shape, work
from . import sql
from . import tables as t

QUERIES: dict = {}
CHECKS: dict = {}
CLAIM_FIELDS = ("name", "url")


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


# merge -----------------------------------------------------------------------------

_KEYED = f"""
keyed AS (
  SELECT *, sha256(k0) AS k
  FROM (SELECT *, coalesce(nullif({sql.normal('name')}, ''), nullif({sql.url_normal('url')}, '')) AS k0 FROM findings)
)"""
_MERGED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY
           CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
           CASE WHEN name <> '' THEN 1 ELSE 0 END + (category IS NOT NULL)::INT + (summary IS NOT NULL)::INT DESC, ord) AS rk
  FROM keyed
),
agents AS (SELECT k, agent, min(ord) AS first_ord, count(*) AS sightings FROM keyed GROUP BY ALL),
sources AS (SELECT k, arg_min(agent, first_ord) AS first_agent, count(*) AS source_count FROM agents GROUP BY k),
merged AS (
  SELECT k, count(*) AS corroborations, first(name ORDER BY rk) FILTER (WHERE name <> '') AS name,
         first(url ORDER BY rk) AS url, first(confidence ORDER BY rk) AS confidence,
         first(category ORDER BY rk) FILTER (WHERE category IS NOT NULL) AS category,
         first(summary ORDER BY rk) FILTER (WHERE summary IS NOT NULL) AS summary,
         first(finding_id ORDER BY rk) AS finding_id
  FROM ranked GROUP BY k
)"""
_MERGE_CTES = (t.FINDINGS_SQL, _KEYED, _MERGED)


def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merge_findings(t.findings(spark, sf_dir), CLAIM_FIELDS)


@query(
    "merge_findings",
    sql.with_ctes(*_MERGE_CTES)
    + """
SELECT m.k AS key, m.name, m.url, m.confidence, m.category, m.summary, m.finding_id,
       m.corroborations, s.source_count, s.first_agent
FROM merged m JOIN sources s USING (k)""",
)
def merge_findings(spark, sf_dir):
    return merged_claims(spark, sf_dir).select(
        F.col("_key").alias("key"),
        "name",
        "url",
        "confidence",
        "category",
        "summary",
        "finding_id",
        F.col("_corroborations").alias("corroborations"),
        F.col("_source_count").alias("source_count"),
        F.col("_first_agent").alias("first_agent"),
    )


@query(
    "finding_sources",
    sql.with_ctes(*_MERGE_CTES) + "SELECT k AS key, agent, sightings, first_ord FROM agents",
)
def finding_sources(spark, sf_dir):
    return ops.finding_sources(t.findings(spark, sf_dir), CLAIM_FIELDS).select(
        F.col("_key").alias("key"), F.col("_agent").alias("agent"), "sightings", "first_ord"
    )


# verdict ------------------------------------------------------------------------------


def judged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged claims with URL liveness and verdict."""
    live = page_ops.liveness(t.fetch_log(spark, sf_dir))
    claims = ops.attach_url_status(merged_claims(spark, sf_dir), live)
    return ops.adjudicate(claims, t.votes(spark, sf_dir), "finding_id")


_JUDGED = """
tally AS (
  SELECT finding_id, count(*) FILTER (WHERE supported) AS yes, count(supported) AS live,
         string_agg(problem, '; ' ORDER BY lens_ord) AS problems
  FROM votes WHERE supported IS NOT NULL GROUP BY finding_id
),
judged AS (
  SELECT m.*, l.status AS url_status, t.yes, t.live, s.source_count,
         CASE WHEN l.status LIKE 'dead%' OR l.status = 'invalid' THEN 'refuted'
              WHEN t.live IS NULL THEN 'unverified' WHEN t.yes >= 2 THEN 'supported' ELSE 'refuted' END AS verdict,
         CASE WHEN l.status LIKE 'dead%' OR l.status = 'invalid'
              THEN concat_ws('; ', 'primary URL unreachable (' || l.status || ')', t.problems)
              ELSE coalesce(t.problems, '') END AS problems
  FROM merged m JOIN sources s USING (k) LEFT JOIN live l ON l.url = m.url LEFT JOIN tally t ON t.finding_id = m.finding_id
)"""
_JUDGE_CTES = (*_MERGE_CTES, t.VOTES_SQL, t.FETCH_SQL, _JUDGED)


@query(
    "adjudicate",
    sql.with_ctes(*_JUDGE_CTES)
    + """
SELECT k AS key, verdict, CASE WHEN live IS NOT NULL THEN yes || '/' || live END AS verdict_votes, problems, url_status
FROM judged""",
)
def adjudicate(spark, sf_dir):
    return judged_claims(spark, sf_dir).select(
        F.col("_key").alias("key"),
        F.col("_verdict").alias("verdict"),
        F.col("_verdict_votes").alias("verdict_votes"),
        F.array_join("_problems", "; ").alias("problems"),
        F.col("_url_status").alias("url_status"),
    )


@query(
    "corroborated_claims",
    sql.with_ctes(*_JUDGE_CTES)
    + """
SELECT k AS key, name, url, confidence, corroborations, source_count, verdict, url_status,
       row_number() OVER (ORDER BY corroborations DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, k) AS position
FROM judged WHERE source_count >= 2 AND verdict = 'supported' AND url_status IN ('ok', 'redirect_ok')""",
)
def corroborated_claims(spark, sf_dir):
    """Claims of two or more independent sources that survived verification with a live URL."""
    claims = judged_claims(spark, sf_dir).filter(
        (F.col("_source_count") >= 2)
        & (F.col("_verdict") == "supported")
        & F.col("_url_status").isin("ok", "redirect_ok")
    )
    return ops.rank_findings(claims).select(
        F.col("_key").alias("key"),
        "name",
        "url",
        "confidence",
        F.col("_corroborations").alias("corroborations"),
        F.col("_source_count").alias("source_count"),
        F.col("_verdict").alias("verdict"),
        F.col("_url_status").alias("url_status"),
        "position",
    )


@query(
    "synthesis_order",
    sql.with_ctes(*_JUDGE_CTES)
    + "SELECT k AS key, verdict, corroborations FROM judged ORDER BY verdict = 'supported' DESC, corroborations DESC, k LIMIT 200",
)
def synthesis_order(spark, sf_dir):
    return ops.synthesis_order(judged_claims(spark, sf_dir)).select(
        F.col("_key").alias("key"), F.col("_verdict").alias("verdict"), F.col("_corroborations").alias("corroborations")
    )


_SECTIONS = """
CASE verdict WHEN 'supported' THEN 'Verified findings' WHEN 'refuted' THEN 'Refuted findings' ELSE 'Unverified findings' END"""


@query(
    "report_sections",
    sql.with_ctes(*_JUDGE_CTES)
    + f"""
SELECT section, count(*) AS rows, CAST(sum(corroborations) AS BIGINT) AS sightings
FROM (SELECT {_SECTIONS} AS section, corroborations FROM judged
      UNION ALL SELECT 'Coverage gaps', 0 FROM conversations WHERE turn % 3 = 0 AND turn % 4 <> 3)
GROUP BY section""",
)
def report_sections(spark, sf_dir):
    gaps = ops.coverage_gaps(agent_units(spark, sf_dir))
    out = ops.sections(judged_claims(spark, sf_dir), gaps)
    return out.groupBy("section").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce("_corroborations", F.lit(0))).alias("sightings")
    )


@query(
    "section_top_rows",
    sql.with_ctes(*_JUDGE_CTES)
    + f"""
SELECT section, k AS key, position, greatest(n - 40, 0) AS omitted FROM (
  SELECT {_SECTIONS} AS section, k, CAST(row_number() OVER (PARTITION BY verdict ORDER BY corroborations DESC, k) AS INTEGER) AS position,
         count(*) OVER (PARTITION BY verdict) AS n FROM judged) WHERE position <= 40""",
)
def section_top_rows(spark, sf_dir):
    rows = ops.sections(judged_claims(spark, sf_dir))
    top = ops.top_per_section(rows, 40, [F.col("_corroborations").desc(), F.col("_key")])
    return top.select("section", F.col("_key").alias("key"), "position", "omitted")


@query(
    "majority_vote",
    """
WITH v AS (SELECT lang, source, CAST(l.quality AS INTEGER) AS answer, doc_id FROM documents LEFT JOIN labels l USING (doc_id)),
c AS (SELECT lang, source, answer, count(answer) AS n, min(doc_id) AS first FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n DESC, first) AS rk FROM c)
SELECT lang, source, answer, n AS votes, n >= 2 AS agreed FROM r WHERE rk = 1""",
)
def majority_vote(spark, sf_dir):
    votes = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id", "left")
    votes = votes.select("lang", "source", F.col("quality").alias("answer"), "doc_id")
    return ops.majority_vote(votes, ["lang", "source"], "answer", "doc_id")


# URLs -----------------------------------------------------------------------------------


@query(
    "url_normalize",
    f"""
SELECT page_id, {sql.url_normal('url')} AS url_key, {sql.host('url')} AS host,
       CASE WHEN regexp_matches(url, '(?i)/company/[^/?#]+') THEN 'company' WHEN regexp_matches(url, '(?i)/in/[^/?#]+') THEN 'person'
            WHEN contains(url, '/jobs/') THEN 'job' ELSE 'other' END AS kind
FROM pages""",
)
def url_normalize(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select(
        "page_id", url_normal(F.col("url")).alias("url_key"), authority(F.col("url")).alias("host"), url_kind(F.col("url")).alias("kind")
    )


@query("cited_urls", sql.with_ctes(t.FINDINGS_SQL) + "SELECT DISTINCT url FROM findings WHERE url LIKE 'http%'")
def cited_urls(spark, sf_dir):
    return ops.cited_urls(t.findings(spark, sf_dir), "finding_id")


@query(
    "attach_url_status",
    sql.with_ctes(t.FINDINGS_SQL, t.FETCH_SQL)
    + """
SELECT f.finding_id, l.status AS url_status, '{"url":"' || l.status || '"}' AS url_checks
FROM findings f LEFT JOIN live l USING (url)""",
)
def attach_url_status(spark, sf_dir):
    live = page_ops.liveness(t.fetch_log(spark, sf_dir))
    out = ops.attach_url_status(t.findings(spark, sf_dir), live, "finding_id")
    return out.select("finding_id", F.col("_url_status").alias("url_status"), F.to_json("_url_checks").alias("url_checks"))


@query(
    "liveness_summary",
    sql.with_ctes(t.FETCH_SQL)
    + f"""
SELECT host, count(*) AS checked, count(*) FILTER (WHERE status LIKE 'dead%' OR status = 'invalid') AS dead
FROM (SELECT {sql.host('url')} AS host, status FROM live) GROUP BY ROLLUP (host)""",
)
def liveness_summary(spark, sf_dir):
    return ops.liveness_summary(page_ops.liveness(t.fetch_log(spark, sf_dir)))


# agent output --------------------------------------------------------------------------


def agent_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ops.parse_agent_output(t.agent_output(spark, sf_dir), "answer")
    gaps = F.element_at(F.from_json("payload", "map<string,string>"), "gaps")
    return good.withColumn("gaps", gaps).drop("answer")


@query(
    "agent_json_repair",
    """
SELECT conv_id * 1000 + turn AS seq, CASE WHEN turn % 4 = 1 THEN 'results' ELSE 'findings' END AS key, text AS first_name, role AS first_category
FROM conversations WHERE turn % 4 <> 3""",
)
def agent_json_repair(spark, sf_dir):
    good, _ = ops.parse_agent_output(t.agent_output(spark, sf_dir), "answer")
    key = F.regexp_extract("payload", r'^\{"([a-z]+)"', 1)
    items = F.from_json(
        F.element_at(F.from_json("payload", "map<string,string>"), key), "array<struct<name:string,category:string>>"
    )
    return good.select(
        "seq", key.alias("key"), items[0]["name"].alias("first_name"), items[0]["category"].alias("first_category")
    )


@query(
    "agent_json_quarantine",
    "SELECT conv_id * 1000 + turn AS seq, 'I could not find anything about ' || role AS answer FROM conversations WHERE turn % 4 = 3",
)
def agent_json_quarantine(spark, sf_dir):
    _, bad = ops.parse_agent_output(t.agent_output(spark, sf_dir), "answer")
    return bad.select("seq", "answer")


_COLLECTED = """
collected AS (
  SELECT conv_id * 1000 + turn AS seq, 'c' || conv_id || '::' || role AS agent, pos,
         CASE pos WHEN 0 THEN text ELSE 'turn ' || turn END AS name, CASE pos WHEN 0 THEN role ELSE 'overview' END AS category
  FROM conversations, (VALUES (0), (1)) AS p(pos) WHERE turn % 4 <> 3 AND turn % 5 <> 4
)"""


@query(
    "collect_findings",
    sql.with_ctes(_COLLECTED) + "SELECT seq, agent, CAST(pos AS INTEGER) AS pos, name, category FROM collected",
)
def collect_findings(spark, sf_dir):
    raw = ops.typed_findings(ops.collect_findings(agent_units(spark, sf_dir)), ["name", "category"])
    return raw.select("seq", F.col("_agent").alias("agent"), F.col("_pos").alias("pos"), "name", "category")


@query(
    "coverage_gaps",
    """
SELECT '[gap] c' || conv_id AS name, 'gap of ' || role AS summary, 'c' || conv_id || '::' || role AS agent
FROM conversations WHERE turn % 3 = 0 AND turn % 4 <> 3""",
)
def coverage_gaps(spark, sf_dir):
    return ops.coverage_gaps(agent_units(spark, sf_dir)).withColumnRenamed("_agent", "agent")


# runs -------------------------------------------------------------------------------------


def _targets(spark, sf_dir):
    return t.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("key"), F.concat(F.lit("conversation "), F.col("conv_id")).alias("label")
    ).distinct()


def _plan(spark, sf_dir):
    even = F.substring("key", 2, 20).cast("long") % 2 == 0
    return work.plan_units(_targets(spark, sf_dir), [("user", None), ("assistant", None), ("system", even)])


_PLAN = """
plan AS (
  SELECT 'c' || conv_id AS target, 'conversation ' || conv_id AS target_label, dimension, 'c' || conv_id || '::' || dimension AS unit_key
  FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('user'), ('assistant'), ('system')) AS d(dimension)
  WHERE dimension <> 'system' OR conv_id % 2 = 0
),
latest AS (
  SELECT * FROM (SELECT 'c' || conv_id || '::' || role AS unit_key, conv_id, role, turn,
                        row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1
)"""


@query("work_matrix", sql.with_ctes(_PLAN) + "SELECT target, target_label, dimension, unit_key FROM plan")
def work_matrix(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(
    "planned_units",
    sql.with_ctes(_PLAN)
    + "SELECT unit_key, target, target_label, dimension FROM plan WHERE unit_key IN (SELECT 'c' || conv_id || '::' || role FROM conversations)",
)
def planned_units(spark, sf_dir):
    saved = t.agent_output(spark, sf_dir).select("unit_key")
    even = F.substring("key", 2, 20).cast("long") % 2 == 0
    return work.plan_units(
        _targets(spark, sf_dir), [("user", None), ("assistant", None), ("system", even)], saved
    ).select("unit_key", "target", "target_label", "dimension")


@query(
    "pending_units",
    sql.with_ctes(_PLAN)
    + "SELECT unit_key, target, dimension FROM plan WHERE unit_key NOT IN (SELECT unit_key FROM latest WHERE turn % 5 <> 4)",
)
def pending_units(spark, sf_dir):
    out = work.pending_units(_plan(spark, sf_dir), t.agent_output(spark, sf_dir))
    return out.select("unit_key", "target", "dimension")


@query(
    "latest_units",
    sql.with_ctes(_PLAN)
    + "SELECT unit_key, conv_id * 1000 + turn AS seq, CASE WHEN turn % 5 = 4 THEN 'timeout' END AS error FROM latest",
)
def latest_units(spark, sf_dir):
    return work.latest_units(t.agent_output(spark, sf_dir)).select("unit_key", "seq", "error")


@query(
    "unit_keys",
    """
SELECT DISTINCT 'c' || conv_id || '::' || role AS unit_key,
       'c' || conv_id || '-' || role || '-' || substr(sha1('c' || conv_id || '::' || role), 1, 8) AS file_key,
       'c' || conv_id || '-' || role AS slug
FROM conversations""",
)
def unit_keys(spark, sf_dir):
    keys = t.agent_output(spark, sf_dir).select("unit_key").distinct()
    return keys.select("unit_key", file_key(F.col("unit_key")).alias("file_key"), slug(F.col("unit_key")).alias("slug"))


@query(
    "run_progress",
    """
SELECT conv_id % 10 AS run_id, count(*) AS done, count(*) FILTER (WHERE turn % 5 <> 4) AS succeeded,
       round(CAST(sum(length(text) % 100) AS DOUBLE) / 100, 4) AS cost_usd
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1) GROUP BY 1""",
)
def run_progress(spark, sf_dir):
    """Every unit is delivered twice, which counts once."""
    units = t.agent_output(spark, sf_dir).withColumn("cost_usd", F.col("cents") / 100)
    return work.run_progress(units.unionByName(units))


@query(
    "cost_estimate",
    sql.with_ctes(_PLAN)
    + """
SELECT count(*) AS agents, count(DISTINCT target) AS targets, count(DISTINCT dimension) AS dimensions, v AS verify,
       round(count(*) * 0.066::DOUBLE + CASE WHEN v THEN count(*) * 0.4::DOUBLE ELSE 0 END, 2) AS est_cost_low_usd,
       round(count(*) * 0.066::DOUBLE * 1.2::DOUBLE + CASE WHEN v THEN count(*) * 1.6::DOUBLE ELSE 0 END, 2) AS est_cost_high_usd
FROM plan, (VALUES (true), (false)) AS b(v) GROUP BY v""",
)
def cost_estimate(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return work.estimate(plan, True).unionByName(work.estimate(plan, False))


@query(
    "run_stats",
    sql.with_ctes(_PLAN, *_JUDGE_CTES, _COLLECTED, t.CALLS_SQL)
    + """
SELECT (SELECT bool_or(running - cost_e8 >= 5000000) FROM (SELECT cost_e8, sum(cost_e8) OVER (PARTITION BY run_id ORDER BY call_id) AS running FROM priced)) AS aborted,
       (SELECT CAST(max(finished_s) - min(finished_s - 7 * attempt) AS DOUBLE) FROM attempts) AS elapsed_s,
       (SELECT count(DISTINCT target) FROM plan) AS targets, (SELECT count(DISTINCT dimension) FROM plan) AS dimensions,
       (SELECT count(*) FROM plan) AS units_total,
       (SELECT count(*) FROM latest WHERE turn % 5 <> 4) AS units_completed, (SELECT count(*) FROM latest WHERE turn % 5 = 4) AS units_failed,
       (SELECT count(*) FROM plan WHERE unit_key IN (SELECT unit_key FROM latest WHERE turn % 5 <> 4)) AS units_resumed,
       (SELECT count(*) FROM collected JOIN latest l ON agent = l.unit_key AND seq = l.conv_id * 1000 + l.turn) AS findings_raw, count(*) AS findings_unique,
       count(*) FILTER (WHERE verdict = 'supported') AS findings_verified, count(*) FILTER (WHERE verdict = 'refuted') AS findings_refuted,
       count(*) FILTER (WHERE url_status LIKE 'dead%' OR url_status = 'invalid') AS urls_dead
FROM judged""",
)
def run_stats(spark, sf_dir):
    units = work.latest_units(t.agent_output(spark, sf_dir))
    good, _ = ops.parse_agent_output(units, "answer")  # of the last delivery of each unit, not of superseded ones
    raw = ops.collect_findings(good)
    calls = work.budget_cutoff(work.price_calls(t.llm_calls(spark, sf_dir), t.prices(spark)), 0.05)
    steps = t.fetch_log(spark, sf_dir).withColumn("started_s", F.col("finished_s") - 7 * F.col("attempt"))
    return ops.run_stats(_plan(spark, sf_dir), units, raw, judged_claims(spark, sf_dir), calls, steps)


# cost -------------------------------------------------------------------------------------


@query(
    "ledger_by_model",
    sql.with_ctes(t.CALLS_SQL)
    + """
SELECT model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       round(CAST(sum(cost_e8) AS DOUBLE) / 1e8, 4) AS cost_usd
FROM priced GROUP BY ROLLUP (model)""",
)
def ledger_by_model(spark, sf_dir):
    return work.ledger(work.price_calls(t.llm_calls(spark, sf_dir), t.prices(spark)))


@query(
    "budget_cutoff",
    sql.with_ctes(t.CALLS_SQL)
    + """
SELECT run_id, call_id, round(CAST(running AS DOUBLE) / 1e8, 8) AS running_usd,
       CASE WHEN running - cost_e8 >= 5000000 THEN 'blocked' WHEN running >= 5000000 THEN 'crossing' ELSE 'allowed' END AS outcome
FROM (SELECT *, CAST(sum(cost_e8) OVER (PARTITION BY run_id ORDER BY call_id) AS BIGINT) AS running FROM priced)""",
)
def budget_cutoff(spark, sf_dir):
    priced = work.price_calls(t.llm_calls(spark, sf_dir), t.prices(spark))
    return work.budget_cutoff(priced, 0.05).select(
        "run_id", "call_id", F.round(F.col("running_usd").cast("double"), 8).alias("running_usd"), "outcome"
    )


# output shape --------------------------------------------------------------------------------


@query(
    "export_cells",
    sql.with_ctes(*_JUDGE_CTES)
    + """
SELECT j.name, j.url, j.confidence, coalesce(j.category, '') AS category, coalesce(j.summary, '') AS summary, CAST(j.finding_id AS VARCHAR) AS finding_id,
       j.verdict, coalesce(CASE WHEN live IS NOT NULL THEN yes || '/' || live END, '') AS verdict_votes,
       CAST(j.corroborations AS VARCHAR) AS corroborations, j.url_status
FROM judged j""",
)
def export_cells(spark, sf_dir):
    """Claims as flat text cells, substantive columns first, then provenance."""
    return shape.flat_cells(judged_claims(spark, sf_dir), include_provenance=True)
