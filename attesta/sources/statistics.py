"""Official-statistics payloads to rows.

A payload is one response and one row. It is decoded inside the row and exploded last,
so that no row of the result carries the payload's code lists with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import cell_under, let, map_of_last

_CELL = "array<struct<dims:map<string,string>,codes:map<string,string>,value:double>>"


def _others(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != "payload"]


def _known(names: Column, values: Column) -> Column:
    named = F.zip_with(names, values, lambda n, v: F.struct(n.alias("key"), v.alias("value")))
    return F.map_filter(map_of_last(named), lambda k, v: v.isNotNull())


# JSON-stat ---------------------------------------------------------------------------


def _code_list(category: Column) -> Column:
    """Codes of a dimension in order: from an index object, an index list, or the labels alone."""
    index = category["index"]
    positions = F.transform(
        F.map_entries(F.from_json(index, "map<string,int>")), lambda e: F.struct(e["value"].alias("at"), e["key"].alias("code"))
    )
    return (
        F.when(index.startswith("{"), F.transform(F.array_sort(positions), lambda e: e["code"]))
        .when(index.startswith("["), F.from_json(index, "array<string>"))
        .otherwise(F.coalesce(F.map_keys(category["label"]), F.array().cast("array<string>")))
    )


def flatten_jsonstat(raw: DataFrame) -> DataFrame:
    """JSON-stat 2.0 cubes to one row per filled cell: label and code maps, and the value.

    A cell's position counts through the product of the dimensions in declared order;
    values may be a full list or an object of the filled positions.
    """
    cube = raw.withColumn(
        "_c", F.from_json("payload", "struct<id:array<string>,size:array<int>,dimension:map<string,string>,value:string>")
    )
    ids = F.coalesce(F.col("_c.id"), F.from_json(F.col("_c.dimension")["id"], "array<string>"))
    sizes = F.coalesce(F.col("_c.size"), F.from_json(F.col("_c.dimension")["size"], "array<int>"))
    category = "struct<category:struct<index:string,label:map<string,string>>>"

    def lists(name: Column) -> Column:
        meta = F.from_json(F.col("_c.dimension")[name], category)["category"]
        return let(
            meta,
            lambda m: let(
                _code_list(m),
                lambda codes: F.struct(
                    codes.alias("codes"), F.transform(codes, lambda c: F.coalesce(m["label"][c], c)).alias("labels")
                ),
            ),
        )

    def stride(size: Column, i: Column) -> Column:
        after = F.slice(F.col("_sizes"), i + 2, F.greatest(F.size("_sizes") - i - 1, F.lit(0)))
        return F.aggregate(after, F.lit(1).cast("long"), lambda a, b: a * b)

    text = F.col("_c.value")
    # Values are read as text and cast one by one, so that one odd cell is missing and not the cube.
    listed = F.transform(
        F.from_json(text, "array<string>"), lambda v, i: F.struct(i.cast("long").alias("at"), v.try_cast("double").alias("value"))
    )
    sparse = F.transform(
        F.map_entries(F.from_json(text, "map<string,string>")),
        lambda e: F.struct(e["key"].try_cast("long").alias("at"), e["value"].try_cast("double").alias("value")),
    )
    filled = F.filter(
        F.when(text.startswith("["), listed).otherwise(sparse), lambda e: e["at"].isNotNull() & e["value"].isNotNull()
    )

    def cell(e: Column) -> Column:
        def pick(part: str) -> Column:
            return F.transform(
                F.col("_lists"),
                lambda d, i: F.get(d[part], (F.floor(e["at"] / F.col("_strides")[i]) % F.col("_sizes")[i]).cast("int")),
            )

        return F.struct(
            _known(F.col("_ids"), pick("labels")).alias("dims"),
            _known(F.col("_ids"), pick("codes")).alias("codes"),
            e["value"].alias("value"),
        )

    staged = (
        cube.withColumn("_dims", F.least(F.size(ids), F.size(sizes)))  # one of them may be longer
        .withColumn("_ids", F.slice(ids, F.lit(1), F.greatest("_dims", F.lit(0))))
        .withColumn("_sizes", F.slice(sizes, F.lit(1), F.greatest("_dims", F.lit(0))))
        .withColumn("_lists", F.transform("_ids", lists))
        .withColumn("_strides", F.transform("_sizes", stride))
    )
    return staged.select(*_others(raw), F.inline(F.transform(filled, cell)))


# SDMX-JSON -------------------------------------------------------------------------------

_SDMX_DIMS = "array<struct<id:string,values:array<struct<id:string,name:string>>>>"
_SDMX_STRUCTURE = f"struct<dimensions:struct<observation:{_SDMX_DIMS},series:{_SDMX_DIMS}>>"
_SDMX_DATA = "array<struct<series:map<string,struct<observations:map<string,array<string>>>>,observations:map<string,array<string>>>>"


def _decoded(key: Column, pool: Column) -> Column:
    """Entries (dimension, label) of a colon-joined key of positions."""
    parts = F.split(key, ":")
    pairs = F.zip_with(parts, F.slice(pool, F.lit(1), F.size(parts)), lambda p, d: F.struct(p.alias("p"), d.alias("d")))
    named = F.transform(
        pairs,
        lambda e, i: F.struct(
            F.coalesce(e["d"]["id"], F.concat(F.lit("dim"), i)).alias("key"),
            let(F.get(e["d"]["values"], e["p"].try_cast("int")), lambda v: F.coalesce(v["name"], v["id"])).alias("value"),
        ),
    )
    return F.filter(named, lambda e: e["value"].isNotNull())


def flatten_sdmx(raw: DataFrame) -> DataFrame:
    """SDMX-JSON, by series or flat, to one row per observation of the first data set."""
    schema = (
        f"struct<structure:{_SDMX_STRUCTURE},dataSets:{_SDMX_DATA},"
        f"data:struct<structures:array<{_SDMX_STRUCTURE}>,dataSets:{_SDMX_DATA}>>"
    )
    parsed = raw.withColumn("_p", F.from_json("payload", schema))
    structure = F.coalesce(F.col("_p.structure"), F.get(F.col("_p.data.structures"), F.lit(0)))
    data = F.get(F.coalesce(F.col("_p.dataSets"), F.col("_p.data.dataSets")), F.lit(0))
    none = F.array().cast(_SDMX_DIMS)
    staged = parsed.select(
        *_others(raw),
        F.coalesce(structure["dimensions"]["observation"], none).alias("_obs_dims"),
        F.coalesce(structure["dimensions"]["series"], none).alias("_series_dims"),
        data["series"].alias("_series"),
        data["observations"].alias("_flat"),
    )

    def row(entries: Column, values: Column) -> Column:
        return F.struct(
            map_of_last(entries).alias("dims"), F.get(values, F.lit(0)).try_cast("double").alias("value")
        )

    def of_series(s: Column) -> Column:
        base = _decoded(s["key"], F.col("_series_dims"))
        return F.transform(
            F.map_entries(s["value"]["observations"]),
            lambda o: row(F.concat(base, _decoded(o["key"], F.col("_obs_dims"))), o["value"]),
        )

    both = F.concat("_obs_dims", "_series_dims")
    flat = F.transform(F.map_entries("_flat"), lambda o: row(_decoded(o["key"], both), o["value"]))
    series = F.flatten(F.transform(F.map_entries("_series"), of_series))
    rows = F.when(F.size("_series") > 0, series).otherwise(flat)
    return staged.select(*_others(raw), F.inline(rows))


def wide_stats(stats: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Long statistics with one column per dimension label and, where known, its code."""
    codes = "codes" in stats.columns
    others = [c for c in stats.columns if c not in ("dims", "codes")]
    cols = []
    for name in dims:
        cols.append(F.try_element_at("dims", F.lit(name)).alias(name))
        if codes:
            cols.append(F.try_element_at("codes", F.lit(name)).alias(f"{name}_code"))
    return stats.select(*others, *cols)


# matrices and row lists ------------------------------------------------------------------


def census_number(col: Column) -> Column:
    """Number of a measure; the service's large negative marks mean "not available"."""
    return let(col.try_cast("double"), lambda x: F.when(x > fixed.CENSUS_SENTINEL, x))


def read_census_matrix(raw: DataFrame, labels: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A matrix whose first row is its header; only ``measures`` become numbers, codes keep their zeros."""
    matrix = raw.withColumn("_m", F.from_json("payload", "array<array<string>>"))
    body = F.slice("_m", F.lit(2), F.greatest(F.size("_m") - 1, F.lit(0)))
    header, row = F.col("_h"), F.col("_r")
    return matrix.select(*_others(raw), F.get("_m", F.lit(0)).alias("_h"), F.explode(body).alias("_r")).select(
        *_others(raw),
        *[cell_under(header, row, c).alias(c) for c in labels],
        *[census_number(cell_under(header, row, c)).alias(c) for c in measures],
    )


def read_census_variables(raw: DataFrame) -> DataFrame:
    """Variable dictionary: one row per code."""
    schema = "struct<variables:map<string,struct<label:string,concept:string,group:string>>>"
    items = F.from_json("payload", schema)["variables"]
    return raw.select(*_others(raw), F.explode(items).alias("code", "_v")).select(*_others(raw), "code", "_v.*")


def read_worldbank(raw: DataFrame) -> DataFrame:
    """``[metadata, rows]`` responses."""
    schema = (
        "array<struct<country:struct<value:string>,countryiso3code:string,indicator:struct<value:string>,"
        "date:string,value:double,unit:string>>"
    )
    second = F.get(F.from_json("payload", "array<string>"), F.lit(1))
    rows = raw.select(*_others(raw), F.explode(F.from_json(second, schema)).alias("r"))
    return rows.select(
        *_others(raw),
        F.col("r.country.value").alias("country"),
        F.col("r.countryiso3code").alias("iso3"),
        F.col("r.indicator.value").alias("indicator"),
        F.col("r.date").alias("year"),
        F.col("r.value").alias("value"),
        F.col("r.unit").alias("unit"),
    )


def read_pxweb_metadata(raw: DataFrame, max_values: int | None = None) -> DataFrame:
    """A table's variables, each with all its values, or the first ``max_values``."""
    schema = (
        "struct<variables:array<struct<code:string,text:string,values:array<string>,valueTexts:array<string>,"
        "elimination:boolean,time:boolean>>>"
    )
    rows = raw.select(*_others(raw), F.explode(F.from_json("payload", schema)["variables"]).alias("v"))

    def head(col: Column) -> Column:
        col = F.coalesce(col, F.array().cast("array<string>"))
        return col if max_values is None else F.slice(col, 1, max_values)

    return rows.select(
        *_others(raw), "v.code", "v.text", head(F.col("v.values")).alias("values"),
        head(F.col("v.valueTexts")).alias("value_texts"), "v.elimination", "v.time",
    )


# company registers --------------------------------------------------------------------------

_REGISTER_SCHEMAS = {
    "companies_house": (
        "struct<items:array<struct<company_number:string,title:string,company_status:string,company_type:string,"
        "date_of_creation:string,address_snippet:string,links:struct<self:string>>>>"
    ),
    "edgar": (
        "struct<hits:struct<hits:array<struct<_id:string,_source:struct<file_type:string,file_date:string,"
        "display_names:array<string>,ciks:array<string>>>>>>"
    ),
    "gleif": (
        "struct<data:array<struct<attributes:struct<lei:string,entity:struct<legalName:struct<name:string>,status:string,"
        "legalAddress:struct<country:string,city:string>,legalForm:struct<id:string>,registeredAs:string>>>>>"
    ),
}


def read_registry(raw: DataFrame, kind: str) -> DataFrame:
    """Company-register responses as rows of one shape; what a register lacks is null."""
    parsed = F.from_json("payload", _REGISTER_SCHEMAS[kind])
    items = {"companies_house": parsed["items"], "edgar": parsed["hits"]["hits"], "gleif": parsed["data"]}[kind]
    at = {
        "companies_house": {
            "register_id": "r.company_number", "name": "r.title", "status": "r.company_status", "form": "r.company_type",
            "dated": "r.date_of_creation", "address": "r.address_snippet", "path": "r.links.self",
        },
        "edgar": {"register_id": "r._id", "form": "r._source.file_type", "dated": "r._source.file_date"},
        "gleif": {
            "register_id": "r.attributes.lei", "name": "r.attributes.entity.legalName.name", "status": "r.attributes.entity.status",
            "form": "r.attributes.entity.legalForm.id", "country": "r.attributes.entity.legalAddress.country",
            "city": "r.attributes.entity.legalAddress.city", "number": "r.attributes.entity.registeredAs",
        },
    }[kind]
    cols = {name: F.col(path) for name, path in at.items()}
    if kind == "edgar":
        cols["name"] = F.get("r._source.display_names", F.lit(0))
        cols["number"] = F.get("r._source.ciks", F.lit(0))
    names = ("register_id", "name", "status", "form", "dated", "address", "path", "country", "city", "number")
    rows = raw.select(*_others(raw), F.explode(items).alias("r"))
    out = rows.select(
        *_others(raw),
        F.lit(kind).alias("register"),
        *[cols.get(n, F.lit(None).cast("string")).alias(n) for n in names],
    )
    site = F.lit("https://find-and-update.company-information.service.gov.uk")
    url = F.when(F.col("register") == "companies_house", F.concat(site, F.coalesce("path", F.lit(""))))
    return out.withColumn("url", url).drop("path")


def join_on_place_and_year(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("iso3", "year")) -> DataFrame:
    """Statistics of two sources side by side."""
    return left.join(right, list(keys))
