"""A landed run: the given tables written as a run leaves them, and read back; queries and their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import work
from ..session import shared_folder
from ..sinks import files
from ..sources import landed
from . import tables as t

QUERIES: dict = {}
CHECKS: dict = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


_landed: dict[tuple[str, str], str] = {}


def _values(spark, sf_dir):
    """A turn is a checkpoint, a conversation's ten a run; every seventh turn and every ninth page is cut in half."""
    turns = t.table(spark, sf_dir, "conversations").withColumn("run_id", F.concat(F.lit("run-"), F.col("conv_id") % 10))
    target = F.concat(F.lit("c"), F.col("conv_id"))
    unit = F.struct(
        F.concat(target, F.lit("::"), "role").alias("_key"),
        F.date_format(F.timestamp_seconds(F.lit(800_000_000) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("_saved_at"),
        F.struct(target.alias("target"), F.col("role").alias("dimension"), (F.col("turn") / 4).alias("cost_usd")).alias("_meta"),
        F.when(F.col("turn") % 5 == 4, "timeout").alias("error"),
        F.array(F.struct(F.col("text").alias("name"))).alias("findings"),
    )
    units = turns.select("run_id", F.lit("units").alias("kind"), F.to_json(unit).alias("body"), (F.col("turn") % 7 == 6).alias("cut"))
    pages = t.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("run-"), F.col("page_id") % 10).alias("run_id"), F.lit("pages").alias("kind"),
        F.to_json(F.struct("url", (200 + F.col("page_id") % 3).alias("status"), F.struct(F.col("html").alias("text")).alias("doc"))).alias("body"),
        (F.col("page_id") % 9 == 8).alias("cut"),
    )
    found = t.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("run-"), F.col("doc_id") % 10).alias("run_id"), F.lit("findings").alias("kind"),
        F.to_json(F.struct("doc_id", F.col("text").alias("name"), "lang")).alias("body"), F.lit(False).alias("cut"),
    )
    # A plan is told in parts of a thousand conversations, so that no row holds a whole run.
    planned = turns.filter("turn = 0").groupBy("run_id", F.floor(F.col("conv_id") / 1000)).agg(F.collect_set(F.concat(target, F.lit("::user"))).alias("planned_units"))
    manifests = planned.select(
        "run_id", F.lit("manifest").alias("kind"),
        F.to_json(F.struct(F.lit("running").alias("status"), F.struct("planned_units").alias("spec"))).alias("body"),
        (F.col("run_id") == "run-9").alias("cut"),
    )
    rows = units.unionByName(pages).unionByName(found).unionByName(manifests)
    half = F.substring("body", F.lit(1), (F.length("body") / 2).cast("int"))
    return rows.select("run_id", "kind", F.when(F.col("cut"), half).otherwise(F.col("body")).alias("body"))


def folder(spark, sf_dir) -> str:
    """The given tables as a landed run, written once per application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _landed:
        path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
        files.write_landed(_values(spark, sf_dir), f"{path}/lines")
        files.compact_units(landed.read_units(spark, f"{path}/lines", lines=True)[0], f"{path}/units")
        _landed[at] = path
    return _landed[at]


_LAST = """
last_units AS (
  SELECT 'run-' || conv_id % 10 AS run_id, 'c' || conv_id || '::' || role AS unit_key, 'c' || conv_id AS target, role AS dimension, turn / 4 AS cost_usd,
         CASE WHEN turn % 5 = 4 THEN 'timeout' END AS error, TIMESTAMP '1995-05-09 06:13:20' + to_seconds(turn) AS saved_at
  FROM conversations WHERE turn % 7 <> 6
  QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1
)"""


@query("landed_units", f"WITH {_LAST} SELECT run_id, unit_key, target, dimension, cost_usd, error, saved_at FROM last_units")
def landed_units(spark, sf_dir):
    """The last readable checkpoint of every unit, from the compacted generation."""
    units = spark.read.parquet(f"{folder(spark, sf_dir)}/units")
    return units.select(F.col("run_id").cast("string").alias("run_id"), "unit_key", "target", "dimension", "cost_usd", "error", "saved_at")


@query(
    "landed_pages",
    "SELECT sha1(url) AS page_key, url, CAST(200 + page_id % 3 AS INTEGER) AS status, html AS text FROM pages WHERE page_id % 9 <> 8",
)
def landed_pages(spark, sf_dir):
    pages, _ = landed.read_pages(spark, f"{folder(spark, sf_dir)}/lines", lines=True)
    return pages.select("page_key", "url", "status", F.col("doc.text").alias("text"))


@query("landed_findings", "SELECT 'run-' || doc_id % 10 AS run_id, CAST(doc_id AS VARCHAR) AS doc_id, text AS name, lang FROM documents")
def landed_findings(spark, sf_dir):
    found = landed.read_findings(spark, f"{folder(spark, sf_dir)}/lines", lines=True)
    return found.select("run_id", *(F.try_element_at("finding", F.lit(k)).alias(k) for k in ("doc_id", "name", "lang")))


@query(
    "landed_quarantine",
    """
SELECT 'run-' || conv_id % 10 AS run_id, 'units' AS kind, count(*) AS damaged FROM conversations WHERE turn % 7 = 6 GROUP BY ALL
UNION ALL SELECT 'run-' || page_id % 10, 'pages', count(*) FROM pages WHERE page_id % 9 = 8 GROUP BY ALL
UNION ALL SELECT 'run-9', 'manifest', count(DISTINCT conv_id // 1000) FROM conversations WHERE conv_id % 10 = 9 AND turn = 0 HAVING count(*) > 0""",
)
def landed_quarantine(spark, sf_dir):
    return landed.quarantine(spark, f"{folder(spark, sf_dir)}/lines")


@query(
    "landed_resume",
    f"""
WITH {_LAST}
SELECT DISTINCT 'run-' || conv_id % 10 AS run_id, 'c' || conv_id || '::user' AS unit_key FROM conversations
WHERE turn = 0 AND conv_id % 10 <> 9 AND 'c' || conv_id || '::user' NOT IN (SELECT unit_key FROM last_units WHERE error IS NULL)""",
)
def landed_resume(spark, sf_dir):
    """Planned units of readable manifests that are still to be done."""
    path = folder(spark, sf_dir)
    runs, _ = landed.read_runs(spark, f"{path}/lines", lines=True)
    return work.pending_units(landed.planned_units(runs), spark.read.parquet(f"{path}/units")).select("run_id", "unit_key")
