"""Files a run leaves behind: manifests, unit checkpoints, pages and findings.

A run is read from a file per value, ``<run>/<kind>/*.json``, or, with ``lines``, from what
``sinks.files.write_landed`` wrote: a value per line in a folder per run and kind, so that no file is one
string and a kind is a partition filter. A value is whole JSON and nothing else, or it is quarantined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.loose_json import whole_json

_META = "struct<target:string,target_label:string,dimension:string,model:string,cost_usd:double,attempts:int>"
_MANIFEST = (
    "struct<topic:string,status:string,created_at:string,finished_at:string,"
    "spec:struct<planned_units:array<string>,targets:array<struct<key:string,label:string>>,dedupe_fields:array<string>>,"
    "ledger:struct<cost_usd:double>>"
)
_DOC = (
    "struct<title:string,markdown:string,text:string,description:string,byline:string,published_at:string,"
    "lang:string,canonical:string,links:array<string>,word_count:bigint,strategy:string>"
)
_PAGE = (
    "struct<url:string,ok:boolean,status:int,final_url:string,content_type:string,elapsed_ms:bigint,attempts:int,"
    f"error:string,fetched_at:string,doc:{_DOC}>"
)


def _values(spark: SparkSession, path: str, kind: str, lines: bool) -> tuple[DataFrame, DataFrame]:
    """Values of a kind as (run_id, file, body), and those that are not one JSON value as (file, body)."""
    if lines:
        rows = spark.read.schema("body string, run_id string, kind string").text(path).filter(F.col("kind") == kind)
        rows = rows.select("run_id", F.col("_metadata.file_path").alias("file"), "body")
    else:
        place = f"{kind}/*.json" if kind in ("units", "pages") else f"{kind}.json"
        rows = spark.read.text(f"{path}/*/{place}", wholetext=True).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"))
        run = F.regexp_extract("file", rf"([^/]+)/{kind}(?:/[^/]+)?\.json$", 1)
        rows = rows.select(run.alias("run_id"), "file", "body")
    good = F.coalesce(whole_json(F.trim("body")).isNotNull(), F.lit(False))
    return rows.filter(good), rows.filter(~good).select("file", "body")


def read_units(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Checkpoints, and what is not JSON."""
    good, bad = _values(spark, path, "units", lines)
    fields = F.from_json("body", "map<string,string>")
    meta = F.from_json(F.col("_f")["_meta"], _META)
    units = good.withColumn("_f", fields).withColumn("_m", meta).select(
        "run_id",
        F.col("_f")["_key"].alias("unit_key"),
        F.col("_f")["_saved_at"].try_cast("timestamp").alias("saved_at"),
        (F.xxhash64("body") if lines else F.xxhash64("file")).alias("seq"),
        "_m.target",
        "_m.dimension",
        "_m.cost_usd",
        F.col("_f")["error"].alias("error"),
        F.col("_f")["gaps"].alias("gaps"),
        F.col("body").alias("payload"),
    )
    return units, bad


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fetched pages keyed by the digest of their URL, and what is not JSON."""
    good, bad = _values(spark, path, "pages", lines)
    pages = good.select(F.from_json("body", _PAGE).alias("p")).select(F.sha1("p.url").alias("page_key"), "p.*")
    return pages, bad


def read_findings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Merged findings of finished runs, one open map each: a line is a finding, a file a list of them."""
    good, _ = _values(spark, path, "findings", lines)
    if lines:
        return good.select("run_id", F.from_json("body", "map<string,string>").alias("finding"))
    items = F.from_json("body", "struct<findings:array<string>>")["findings"]
    rows = good.select("run_id", F.posexplode(items).alias("_pos", "_item"))
    return rows.select("run_id", "_pos", F.from_json("_item", "map<string,string>").alias("finding"))


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs by their manifests, and the manifests that are not JSON."""
    good, bad = _values(spark, path, "manifest", lines)
    runs = good.select("run_id", F.from_json("body", _MANIFEST).alias("m")).select(
        "run_id", "m.topic", "m.status", "m.created_at", "m.finished_at", F.col("m.ledger.cost_usd").alias("cost_usd"),
        F.col("m.spec.planned_units").alias("planned_units"), F.col("m.spec.targets").alias("targets"),
    )
    return runs, bad


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Damaged lines of every kind, with their number for each run."""
    parts = [_values(spark, path, kind, True)[1].withColumn("kind", F.lit(kind)) for kind in ("units", "pages", "findings", "manifest")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    run = F.regexp_extract("file", r"run_id=([^/]+)/", 1)
    return rows.groupBy(run.alias("run_id"), "kind").agg(F.count("*").alias("damaged"))


def planned_units(runs: DataFrame) -> DataFrame:
    """The saved plan of every run, one row per unit."""
    return runs.select("run_id", F.explode("planned_units").alias("unit_key"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run whose id sorts last; run ids start with their time."""
    return runs.agg(F.max("run_id").alias("run_id"))
