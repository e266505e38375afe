"""The given tables, and the inputs derived from them in Spark and, for checks, in SQL.

Both derivations use integer arithmetic only, so that they agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reference import dim_prices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# findings -------------------------------------------------------------------------


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per document: its whole text is the claim, a page its source."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    pages = table(spark, sf_dir, "pages")
    cited = F.col("doc_id") % pages.select(F.count("*")).scalar()
    confidence = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    category = F.when(F.col("toxic") == 1, "risk").when(F.col("toxic") == 0, "overview")
    return (
        docs.join(labels, "doc_id", "left")
        .withColumn("page_id", cited)
        .join(pages.select("page_id", "url"), "page_id")
        .select(
            F.col("text").alias("name"),
            "url",
            confidence.alias("confidence"),
            category.alias("category"),
            F.when(F.col("quality") == 1, F.col("lang")).alias("summary"),
            F.col("doc_id").alias("finding_id"),
            F.col("source").alias("_agent"),
            F.col("doc_id").alias("_ord"),
        )
    )


FINDINGS_SQL = """
findings AS (
  SELECT d.text AS name, p.url,
         CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS confidence,
         CASE l.toxic WHEN 1 THEN 'risk' WHEN 0 THEN 'overview' END AS category,
         CASE WHEN l.quality = 1 THEN d.lang END AS summary,
         d.doc_id AS finding_id, d.source AS agent, d.doc_id AS ord
  FROM documents d LEFT JOIN labels l USING (doc_id)
  JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lenses per finding; documents without a label were not judged."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    judged = F.col("quality").isNotNull()

    def vote(order: int, lens: str, supported, problem: str):
        problems = F.when(judged & ~supported, F.array(F.lit(problem))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.lit(order).alias("lens_ord"),
            F.lit(lens).alias("lens"),
            F.when(judged, supported).alias("supported"),
            problems.alias("problems"),
        )

    ballots = F.array(
        vote(1, "factual accuracy", F.col("quality") == 1, "no real source"),
        vote(2, "recency", F.col("toxic") == 0, "stale"),
        vote(3, "specificity", F.col("n_chars") >= 500, "too general"),
    )
    return rows.select(F.col("doc_id").alias("finding_id"), F.explode(ballots).alias("v")).select("finding_id", "v.*")


VOTES_SQL = """
votes AS (
  SELECT finding_id, lens_ord, lens, supported,
         CASE WHEN supported = false THEN problem END AS problem
  FROM (
    SELECT d.doc_id AS finding_id, 1 AS lens_ord, 'factual accuracy' AS lens, l.quality = 1 AS supported, 'no real source' AS problem
    FROM documents d LEFT JOIN labels l USING (doc_id)
    UNION ALL
    SELECT d.doc_id, 2, 'recency', l.toxic = 0, 'stale' FROM documents d LEFT JOIN labels l USING (doc_id)
    UNION ALL
    SELECT d.doc_id, 3, 'specificity', CASE WHEN l.quality IS NOT NULL THEN d.n_chars >= 500 END, 'too general'
    FROM documents d LEFT JOIN labels l USING (doc_id)
  )
)"""


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to fetch every page: up to two refusals, then an outcome by page number."""
    pages = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 7
    tries = 1 + F.col("page_id") % 3
    last = F.col("attempt") == F.col("tries")
    status = (
        F.when(kind.isin(0, 5), 200).when(kind == 1, 301).when(kind == 2, 404).when(kind == 6, 500)
    )
    error = F.when(kind == 3, F.when(F.col("page_id") % 2 == 0, "timeout").otherwise("other")).when(kind == 4, "connect")
    types = F.array(*[F.lit(t) for t in ("text/html", "text/html", "application/pdf", "text/plain", "application/xhtml+xml")])
    return (
        pages.select("page_id", "url", tries.cast("int").alias("tries"))
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("tries"))))
        .select(
            "page_id",
            "url",
            "attempt",
            F.when(last, status).otherwise(F.lit(503)).alias("status"),
            F.when(last, error).alias("error_class"),
            F.get(types, (F.col("page_id") % 5).cast("int")).alias("content_type"),
            (F.col("page_id") * 10 + F.col("attempt") * 7).alias("finished_s"),
            (F.col("page_id") * 10 + F.col("attempt")).alias("seq"),
        )
    )


FETCH_SQL = """
attempts AS (
  SELECT page_id, url, CAST(attempt AS INTEGER) AS attempt,
         CAST(CASE WHEN attempt < 1 + page_id % 3 THEN 503
              WHEN page_id % 7 IN (0, 5) THEN 200 WHEN page_id % 7 = 1 THEN 301
              WHEN page_id % 7 = 2 THEN 404 WHEN page_id % 7 = 6 THEN 500 END AS INTEGER) AS status,
         CASE WHEN attempt < 1 + page_id % 3 THEN NULL
              WHEN page_id % 7 = 3 THEN CASE WHEN page_id % 2 = 0 THEN 'timeout' ELSE 'other' END
              WHEN page_id % 7 = 4 THEN 'connect' END AS error_class,
         (['text/html', 'text/html', 'application/pdf', 'text/plain', 'application/xhtml+xml'])[1 + page_id % 5] AS content_type,
         page_id * 10 + attempt * 7 AS finished_s
  FROM (SELECT page_id, url, unnest(range(1, 2 + page_id % 3)) AS attempt FROM pages)
),
live AS (
  SELECT url, CASE WHEN error_class = 'timeout' THEN 'dead_timeout' WHEN error_class = 'connect' THEN 'dead_connect'
                   WHEN error_class IS NOT NULL THEN 'invalid'
                   WHEN status < 300 THEN 'ok' WHEN status < 400 THEN 'redirect_ok'
                   ELSE 'dead_' || status END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC, attempt DESC) AS rn FROM attempts)
  WHERE rn = 1
)"""


# agent output ------------------------------------------------------------------------


def agent_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation turn as an agent's answer, wrapped the way agents wrap JSON."""
    turns = table(spark, sf_dir, "conversations")
    items = F.to_json(
        F.array(
            F.struct(F.col("text").alias("name"), F.col("role").alias("category")),
            F.struct(F.concat(F.lit("turn "), F.col("turn")).alias("name"), F.lit("overview").alias("category")),
        )
    )
    gaps = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(',"gaps":"gap of '), "role", F.lit('"'))).otherwise("")
    style = F.col("turn") % 4

    def payload(key: str, stray: str = ""):
        listed = F.regexp_replace(items, r"\]$", stray + "]")
        return F.concat(F.lit('{"' + key + '":'), listed, gaps, F.lit(stray + "}"))

    answer = (
        F.when(style == 0, F.concat(F.lit("```json\n"), payload("findings"), F.lit("\n```")))
        .when(style == 1, F.concat(F.lit("Here is what I found: "), payload("results"), F.lit(" - done.")))
        .when(style == 2, payload("findings", ","))
        .otherwise(F.concat(F.lit("I could not find anything about "), F.col("role")))
    )
    return turns.select(
        (F.col("conv_id") % 10).alias("run_id"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("target"),
        F.col("role").alias("dimension"),
        F.concat_ws("::", F.concat(F.lit("c"), F.col("conv_id")), "role").alias("unit_key"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("saved_at"),
        F.when(F.col("turn") % 5 == 4, "timeout").alias("error"),
        (F.length("text") % 100).alias("cents"),
        F.col("turn"),
        F.col("role"),
        F.col("text"),
        answer.alias("answer"),
    )


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation turn as a model call, in the order of its number."""
    models = F.array(F.lit("moonshotai/kimi-k2.6"), F.lit("qwen/qwen3.8-max"), F.lit("unlisted/model"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"),
        (F.col("conv_id") % 10).alias("run_id"),
        F.get(models, (F.col("conv_id") % 3).cast("int")).alias("model"),
        (F.length("text").cast("long") * 10).alias("prompt_tokens"),
        (F.length("text").cast("long") * 5).alias("completion_tokens"),
    )


CALLS_SQL = """
calls AS (
  SELECT conv_id * 1000 + turn AS call_id, conv_id % 10 AS run_id,
         (['moonshotai/kimi-k2.6', 'qwen/qwen3.8-max', 'unlisted/model'])[1 + conv_id % 3] AS model,
         CAST(length(text) * 10 AS BIGINT) AS prompt_tokens, CAST(length(text) * 5 AS BIGINT) AS completion_tokens
  FROM conversations
),
priced AS (
  SELECT *, CAST((prompt_tokens * CASE model WHEN 'moonshotai/kimi-k2.6' THEN 60 WHEN 'qwen/qwen3.8-max' THEN 200 ELSE 100 END
          + completion_tokens * CASE model WHEN 'moonshotai/kimi-k2.6' THEN 250 WHEN 'qwen/qwen3.8-max' THEN 600 ELSE 500 END) AS BIGINT) AS cost_e8
  FROM calls
)"""


def prices(spark: SparkSession) -> DataFrame:
    return dim_prices(spark)
