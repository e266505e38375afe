"""The graph as stored tables that answer a question from the files it concerns.

Tables are partitioned by a hash bucket of the key that questions come with, so a question reads a bucket and not the
table. The log lies by source; by target there are only the keys and what orders them, which lead to the rows. Entities are found over postings: a row for each word, and for
each run of three characters, of an entity's names, aliases and attributes. Keys are computed when a table is written,
never when it is read. A key with a third of the rows fills its bucket with several files, as Spark splits what it
deals out by bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import entity_key
from .graph import add_keys, build_aliases, build_entities, build_relations, entity_attrs

BUCKETS = 64
GRAM = 3
TABLES = ("log", "targets", "relations", "entities", "postings/kind=word", "postings/kind=gram")


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """One folder per bucket; large buckets are split into files of even size, whatever keys they hold."""
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def tokens(text: Column) -> Column:
    """Words of a text, lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+")), "")


def grams(text: Column) -> Column:
    """Every run of three characters, lower case; a shorter text has none."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))


class GraphStore:
    """Written by ``build``, or by ``of`` a table at a time; a method reads only what its question needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._missing: dict[str, tuple[DataFrame, DataFrame]] = {}

    # writing

    @classmethod
    def build(cls, observations: DataFrame, mentions: DataFrame, path: str) -> GraphStore:
        """``mentions`` has name, kind, seen_at, ord, direct and the attributes of direct mentions (map, may be null)."""
        store = cls.of(observations, mentions, path)
        for name in TABLES:
            store.table(name)
        return store

    @classmethod
    def of(cls, observations: DataFrame, mentions: DataFrame, path: str) -> GraphStore:
        """The store that ``build`` makes; a table is written, whole, when the first question needs it."""
        store = cls(observations.sparkSession, path)
        store._missing = dict.fromkeys(TABLES, (observations, mentions))
        return store

    def _make(self, name: str, observations: DataFrame, mentions: DataFrame) -> None:
        path = f"{self.path}/{name}"
        if name == "log":
            _write(add_keys(observations).withColumn("bucket", bucket(F.col("source_key"))), path, "bucket")
        elif name == "targets":
            order = observations.select("source", "source_kind", "predicate", "target", "target_kind", "captured_at", "ord", "source_url")
            ends = add_keys(order).select("target_key", "source_key", "captured_at", "ord", "source_url")
            _write(ends.withColumn("bucket", bucket(F.col("target_key"))), path, "bucket")
        elif name == "relations":
            build_relations(observations).write.mode("overwrite").parquet(path)
        elif name == "entities":
            _write(build_entities(mentions).withColumn("bucket", bucket(F.col("entity_key"))), path, "bucket")
        else:
            self._write_postings(mentions, name, path)

    def _write_postings(self, mentions: DataFrame, name: str, path: str) -> None:
        stated = mentions.where(F.col("attrs").isNotNull())
        names = build_aliases(mentions).select("entity_key", F.col("alias").alias("text"))
        attrs = entity_attrs(stated).select("entity_key", F.col("value").alias("text"))
        texts = names.unionByName(attrs).distinct().join(self.table("entities").select("entity_key", "mentions"), "entity_key")
        if name.endswith("word"):
            rows = texts.select(F.explode(tokens(F.col("text"))).alias("token"), "entity_key", "mentions").distinct()
            postings = rows.withColumn("text", F.lit(None).cast("string"))
        else:
            postings = texts.select(F.explode(grams(F.col("text"))).alias("token"), "entity_key", "mentions", F.lower("text").alias("text"))
        _write(postings.withColumn("bucket", bucket(F.col("token"))), path, "bucket")

    # reading

    def table(self, name: str) -> DataFrame:
        if name in self._missing:
            self._make(name, *self._missing[name])
            del self._missing[name]
        return self.spark.read.parquet(f"{self.path}/{name}")

    def relations(self) -> DataFrame:
        return self.table("relations")

    def entities(self) -> DataFrame:
        return self.table("entities").drop("bucket")

    def _rows_of(self, table: str, column: str, keys: list[str]) -> DataFrame:
        here = F.lit(False) if not keys else reduce(Column.__or__, [F.col("bucket") == bucket(F.lit(k)) for k in keys])
        return self.table(table).where(here & F.col(column).isin(keys)).drop("bucket")

    def _entities_of(self, keys: list[str]) -> DataFrame:
        return self._rows_of("entities", "entity_key", keys)

    def entity(self, name: str, kind: str) -> DataFrame:
        """The entity of a name: one bucket of entities is read."""
        key = self.spark.range(1).select(entity_key(F.lit(name), F.lit(kind)).alias("k")).first()["k"]
        return self._entities_of([key])

    def provenance(self, entity: str, limit: int = fixed.PROVENANCE_ROWS) -> DataFrame:
        """Who says so: the newest observations with the entity at either end.

        A bucket of each side is read, and of the log by source the buckets of the newest ``limit`` that point here.
        """
        here, newest = F.col("bucket") == bucket(F.lit(entity)), [F.col("captured_at").desc(), F.col("ord").desc(), F.col("source_url")]
        rows = self.table("log").where(here & (F.col("source_key") == entity)).drop("bucket")
        # An edge from the entity to itself is among its own rows. Of other sources, those of the newest rows suffice.
        ends = self.table("targets").where(here & (F.col("target_key") == entity) & (F.col("source_key") != entity))
        keys = sorted({r["source_key"] for r in ends.orderBy(*newest).limit(limit).select("source_key").collect()})
        if keys:
            rows = rows.unionByName(self._rows_of("log", "source_key", keys).where(F.col("target_key") == entity))
        return rows.orderBy(*newest).limit(limit)

    def _postings(self, kind: str, wanted: list[str]) -> DataFrame:
        return self._rows_of(f"postings/kind={kind}", "token", wanted)

    def search(self, query: str, limit: int = fixed.SEARCH_ROWS) -> DataFrame:
        """Entities whose names, aliases and attributes hold every word; failing any, those with a text that contains the query.

        Most mentioned first. Only the postings of the query's words or runs are read; a query under three characters
        that is no word has no runs, and finds nothing.
        """
        words = sorted({w for w in query.lower().split() if w})
        if not words:
            return self.entities().limit(0)
        every = self._postings("word", words).groupBy("entity_key").agg(F.max("mentions").alias("mentions"), F.count_distinct("token").alias("n"))
        best = self._best(every.where(F.col("n") == len(words)), limit)
        low = query.lower()
        if not best and len(low) >= GRAM:
            wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
            met = self._postings("gram", wanted).groupBy("entity_key", "text").agg(F.max("mentions").alias("mentions"), F.count("*").alias("n"))
            holding = met.where((F.col("n") == len(wanted)) & F.contains("text", F.lit(low)))
            best = self._best(holding.groupBy("entity_key").agg(F.max("mentions").alias("mentions")), limit)
        # As many keys as the question asks rows.
        return self._entities_of(best).orderBy(F.col("mentions").desc(), F.col("entity_key"))

    @staticmethod
    def _best(hits: DataFrame, limit: int) -> list[str]:
        return [r["entity_key"] for r in hits.orderBy(F.col("mentions").desc(), F.col("entity_key")).limit(limit).select("entity_key").collect()]
