"""Official statistics: registered queries and their checks.

Payloads are built from the given tables, one cube per supplier and so on, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import statistics as ops
from . import sql
from . import tables as t

QUERIES: dict = {}
CHECKS: dict = {}
_FLAGS, _STATUS = ("A", "N", "R"), ("F", "O")
_YEAR0, _YEARS = 1995, 8
_CELLS = len(_FLAGS) * len(_STATUS) * _YEARS


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


# cubes --------------------------------------------------------------------------------


def _coded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.array_position(F.array(*[F.lit(f) for f in _FLAGS]), F.col("l_returnflag")) - 1
    status = F.array_position(F.array(*[F.lit(s) for s in _STATUS]), F.col("l_linestatus")) - 1
    return t.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), flag.alias("f"), status.alias("s"),
        (F.year("l_shipdate") - _YEAR0).cast("long").alias("y"), "l_quantity",
    )


def _dim(key: str, index, labels: dict[str, str] | None):
    category = [index.alias("index")]
    if labels:
        category.append(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]).alias("label"))
    return F.struct(F.struct(*category).alias("category")).alias(key)


def _cubes(spark: SparkSession, sf_dir: str, sparse: bool) -> DataFrame:
    """One cube per supplier; a cube has a fixed number of cells, so gathering it is bounded."""
    at = (F.col("f") * len(_STATUS) + F.col("s")) * _YEARS + F.col("y")
    cells = _coded_lines(spark, sf_dir).groupBy("supplier", at.alias("at")).agg(F.sum("l_quantity").alias("v"))
    filled = cells.groupBy("supplier").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(_CELLS - 1).cast("long")), lambda i: F.try_element_at("m", i))
    value = F.col("m") if sparse else dense
    positions = F.create_map(*[x for i, f in enumerate(_FLAGS) for x in (F.lit(f), F.lit(i))])
    years = F.array(*[F.lit(str(_YEAR0 + i)) for i in range(_YEARS)])
    payload = F.to_json(
        F.struct(
            F.array(*[F.lit(d) for d in ("flag", "status", "year", "unit")]).alias("id"),
            F.array(F.lit(len(_FLAGS)), F.lit(len(_STATUS)), F.lit(_YEARS), F.lit(1)).alias("size"),
            F.struct(
                _dim("flag", positions, {"A": "Accepted", "N": "None", "R": "Returned"}),
                _dim("status", F.array(*[F.lit(s) for s in _STATUS]), {"F": "Filled", "O": "Open"}),
                _dim("year", years, None),
                F.struct(F.struct(F.create_map(F.lit("QTY"), F.lit("Quantity")).alias("label")).alias("category")).alias("unit"),
            ).alias("dimension"),
            value.alias("value"),
        )
    )
    return filled.select(F.col("supplier").alias("source"), payload.alias("payload"))


_LABELS = """
CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'None' ELSE 'Returned' END AS flag,
CASE l_linestatus WHEN 'F' THEN 'Filled' ELSE 'Open' END AS status, CAST(year(l_shipdate) AS VARCHAR) AS year"""
_JSONSTAT = f"""
SELECT l_suppkey AS source, {_LABELS}, 'Quantity' AS unit, l_returnflag AS flag_code, l_linestatus AS status_code,
       CAST(year(l_shipdate) AS VARCHAR) AS year_code, 'QTY' AS unit_code, sum(l_quantity) AS value
FROM lineitem GROUP BY ALL"""


@query("jsonstat_flatten", _JSONSTAT)
def jsonstat_flatten(spark, sf_dir):
    return ops.wide_stats(ops.flatten_jsonstat(_cubes(spark, sf_dir, False)), ["flag", "status", "year", "unit"])


@query("jsonstat_sparse", _JSONSTAT)
def jsonstat_sparse(spark, sf_dir):
    return ops.wide_stats(ops.flatten_jsonstat(_cubes(spark, sf_dir, True)), ["flag", "status", "year", "unit"])


def _sdmx(spark: SparkSession, sf_dir: str, flat: bool) -> DataFrame:
    cells = _coded_lines(spark, sf_dir).groupBy("supplier", "f", "s", "y").agg(F.sum("l_quantity").alias("v"))

    def dim(name: str, values: dict[str, str]):
        return F.struct(
            F.lit(name).alias("id"),
            F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("name")) for k, v in values.items()]).alias("values"),
        )

    flags, status = dim("flag", {"A": "Accepted", "N": "None", "R": "Returned"}), dim("status", {"F": "Filled", "O": "Open"})
    years = dim("year", {str(_YEAR0 + i): str(_YEAR0 + i) for i in range(_YEARS)})
    observed = F.array(F.col("v"), F.lit(0.0))
    if flat:
        key = F.concat_ws(":", "f", "s", "y")
        made = cells.groupBy("supplier").agg(F.map_from_entries(F.collect_list(F.struct(key, observed))).alias("observations"))
        data = F.struct(F.array(F.struct("observations")).alias("dataSets"), F.array(F.struct(F.struct(F.array(flags, status, years).alias("observation")).alias("dimensions"))).alias("structures"))
        payload = F.to_json(F.struct(data.alias("data")))
    else:
        lines = cells.groupBy("supplier", F.concat_ws(":", "f", "s").alias("key")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("string"), observed))).alias("observations")
        )
        made = lines.groupBy("supplier").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("observations")))).alias("series"))
        structure = F.struct(F.struct(F.array(years).alias("observation"), F.array(flags, status).alias("series")).alias("dimensions"))
        payload = F.to_json(F.struct(structure.alias("structure"), F.array(F.struct("series")).alias("dataSets")))
    return made.select(F.col("supplier").alias("source"), payload.alias("payload"))


_SDMX = f"SELECT l_suppkey AS source, {_LABELS}, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


@query("sdmx_flatten", _SDMX)
def sdmx_flatten(spark, sf_dir):
    return ops.wide_stats(ops.flatten_sdmx(_sdmx(spark, sf_dir, False)), ["flag", "status", "year"])


@query("sdmx_flat_observations", _SDMX)
def sdmx_flat_observations(spark, sf_dir):
    return ops.wide_stats(ops.flatten_sdmx(_sdmx(spark, sf_dir, True)), ["flag", "status", "year"])


# census and world bank ---------------------------------------------------------------------


@query(
    "census_matrix",
    """
SELECT c_mktsegment AS dataset, n_name AS "NAME", lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state, count(*)::DOUBLE AS "B01001_001E",
       CASE WHEN count(*) % 3 <> 0 THEN CAST(max(c_custkey) AS DOUBLE) END AS "B19013_001E"
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name, n_nationkey""",
)
def census_matrix(spark, sf_dir):
    people = t.table(spark, sf_dir, "customer").join(t.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.count("*")
    income = F.when(n % 3 != 0, F.max("c_custkey").cast("string")).otherwise("-666666666")
    state = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    cells = people.groupBy("c_mktsegment", "n_name", "n_nationkey").agg(n.cast("string").alias("n"), income.alias("income"))
    head = F.array(*[F.lit(h) for h in ("NAME", "B01001_001E", "B19013_001E", "state")])
    matrix = F.concat(F.array(head), F.collect_list(F.array("n_name", "n", "income", state)))
    raw = cells.groupBy(F.col("c_mktsegment").alias("dataset")).agg(F.to_json(matrix).alias("payload"))
    return ops.read_census_matrix(raw, ["NAME", "state"], ["B01001_001E", "B19013_001E"])


@query(
    "census_variables",
    """
SELECT p_brand AS dataset, 'P' || p_partkey AS code, p_name AS label, p_type AS concept, CAST(NULL AS VARCHAR) AS "group" FROM part""",
)
def census_variables(spark, sf_dir):
    entry = F.create_map(F.concat(F.lit("P"), "p_partkey"), F.struct(F.col("p_name").alias("label"), F.col("p_type").alias("concept")))
    raw = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.to_json(F.struct(entry.alias("variables"))).alias("payload"))
    return ops.read_census_variables(raw)


def _yearly(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    people = t.table(spark, sf_dir, "customer").join(t.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").cast("string").alias("year")).agg(F.count("*").cast("double").alias("v"))


def _worldbank(spark, sf_dir):
    """One response per nation: a row per year."""
    row = F.struct(
        F.struct(F.col("n_name").alias("value")).alias("country"), F.substring("n_name", 8, 3).alias("countryiso3code"),
        F.struct(F.lit("Orders placed").alias("value")).alias("indicator"), F.col("year").alias("date"), F.col("v").alias("value"), F.lit("").alias("unit"),
    )
    made = _yearly(spark, sf_dir).groupBy("n_name").agg(F.to_json(F.collect_list(row)).alias("rows"), F.count("*").alias("n"))
    payload = F.concat(F.lit('[{"page":1,"total":'), "n", F.lit("},"), "rows", F.lit("]"))
    return made.select(F.lit("orders").alias("source"), payload.alias("payload"))


_WB = """
wb AS (
  SELECT 'orders' AS source, n_name AS country, substr(n_name, 8, 3) AS iso3, 'Orders placed' AS indicator, CAST(year(o_orderdate) AS VARCHAR) AS year,
         count(*)::DOUBLE AS value, '' AS unit
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
)"""


@query("worldbank_rows", sql.with_ctes(_WB) + "SELECT * FROM wb")
def worldbank_rows(spark, sf_dir):
    return ops.read_worldbank(_worldbank(spark, sf_dir))


@query(
    "stats_by_place_and_year",
    sql.with_ctes(_WB)
    + """
SELECT iso3, year, wb.value AS orders, s.quantity
FROM wb JOIN (SELECT substr(n_name, 8, 3) AS iso3, CAST(year(l_shipdate) AS VARCHAR) AS year, sum(l_quantity) AS quantity
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) s USING (iso3, year)""",
)
def stats_by_place_and_year(spark, sf_dir):
    """Orders per nation from one source beside quantities shipped from another."""
    orders = ops.read_worldbank(_worldbank(spark, sf_dir)).select("iso3", "year", F.col("value").alias("orders"))
    places = t.table(spark, sf_dir, "supplier").join(t.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cubes = ops.wide_stats(ops.flatten_jsonstat(_cubes(spark, sf_dir, False)), ["year"])
    shipped = (
        cubes.join(places, cubes.source == places.s_suppkey)
        .groupBy(F.substring("n_name", 8, 3).alias("iso3"), "year")
        .agg(F.sum("value").alias("quantity"))
    )
    return ops.join_on_place_and_year(orders, shipped)


# registers and metadata -----------------------------------------------------------------------


@query(
    "company_registry",
    """
SELECT 'companies_house' AS register, 'CH' || s_suppkey AS register_id, s_name AS name, 'active' AS status, 'ltd' AS form, '2001-01-01' AS dated,
       'Street ' || s_nationkey AS address, NULL::VARCHAR AS country, NULL::VARCHAR AS city, NULL::VARCHAR AS number,
       'https://find-and-update.company-information.service.gov.uk/company/' || s_suppkey AS url FROM supplier
UNION ALL SELECT 'edgar', 'A-' || s_suppkey, s_name, NULL, '10-K', '2002-02-02', NULL, NULL, NULL, 'CIK' || s_suppkey, NULL FROM supplier
UNION ALL SELECT 'gleif', 'LEI' || s_suppkey, s_name, 'ACTIVE', 'XTIQ', NULL, NULL, 'N' || s_nationkey, 'City', CAST(s_suppkey AS VARCHAR), NULL FROM supplier""",
)
def company_registry(spark, sf_dir):
    rows = t.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")

    def raw(payload):
        return rows.select(F.to_json(payload).alias("payload"))

    house = F.struct(
        F.array(
            F.struct(
                F.concat(F.lit("CH"), key).alias("company_number"), F.col("s_name").alias("title"), F.lit("active").alias("company_status"),
                F.lit("ltd").alias("company_type"), F.lit("2001-01-01").alias("date_of_creation"), F.concat(F.lit("Street "), "s_nationkey").alias("address_snippet"),
                F.struct(F.concat(F.lit("/company/"), key).alias("self")).alias("links"),
            )
        ).alias("items")
    )
    source = F.struct(
        F.lit("10-K").alias("file_type"), F.lit("2002-02-02").alias("file_date"), F.array("s_name").alias("display_names"),
        F.array(F.concat(F.lit("CIK"), key)).alias("ciks"),
    )
    edgar = F.struct(F.struct(F.array(F.struct(F.concat(F.lit("A-"), key).alias("_id"), source.alias("_source"))).alias("hits")).alias("hits"))
    entity = F.struct(
        F.struct(F.col("s_name").alias("name")).alias("legalName"), F.lit("ACTIVE").alias("status"),
        F.struct(F.concat(F.lit("N"), "s_nationkey").alias("country"), F.lit("City").alias("city")).alias("legalAddress"),
        F.struct(F.lit("XTIQ").alias("id")).alias("legalForm"), key.cast("string").alias("registeredAs"),
    )
    gleif = F.struct(F.array(F.struct(F.struct(F.concat(F.lit("LEI"), key).alias("lei"), entity.alias("entity")).alias("attributes"))).alias("data"))
    out = ops.read_registry(raw(house), "companies_house")
    return out.unionByName(ops.read_registry(raw(edgar), "edgar")).unionByName(ops.read_registry(raw(gleif), "gleif"))


@query(
    "pxweb_metadata",
    """
SELECT p_partkey AS source, 'brand' AS code, p_name AS text, p_brand || '; ' || p_type AS values, p_brand || '; ' || p_type AS value_texts, p_size % 2 = 0 AS elimination, NULL::BOOLEAN AS time FROM part
UNION ALL SELECT p_partkey, 'year', 'Year', '2001', '', false, true FROM part""",
)
def pxweb_metadata(spark, sf_dir):
    brand = F.struct(
        F.lit("brand").alias("code"), F.col("p_name").alias("text"), F.array("p_brand", "p_type").alias("values"),
        F.array("p_brand", "p_type").alias("valueTexts"), (F.col("p_size") % 2 == 0).alias("elimination"), F.lit(None).cast("boolean").alias("time"),
    )
    year = F.struct(
        F.lit("year").alias("code"), F.lit("Year").alias("text"), F.array(F.lit("2001")).alias("values"),
        F.lit(None).cast("array<string>").alias("valueTexts"), F.lit(False).alias("elimination"), F.lit(True).alias("time"),
    )
    raw = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.to_json(F.struct(F.array(brand, year).alias("variables"))).alias("payload"))
    out = ops.read_pxweb_metadata(raw)
    return out.withColumn("values", F.array_join("values", "; ")).withColumn("value_texts", F.array_join("value_texts", "; "))
