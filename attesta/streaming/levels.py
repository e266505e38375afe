"""Tables that streams keep, in levels.

A batch writes a part of level 0. When a level has ``fan`` parts they are merged by key into one part of the next, so
after n batches a read opens at most (fan - 1) * log_fan(n) parts, and a row is rewritten at most log_fan(n) times. The
parts that count are named by a manifest, which is written aside and renamed: a reader sees the parts before a batch or
after it. A batch whose number the manifest has already is not applied again; one that was cut off between its part and
its manifest writes the same part anew.

``merge`` puts rows of several parts together, and must not care how they are grouped (sums, extremes, newest by
``batch_id``). ``live`` says which merged rows are still wanted. Others leave when the oldest part is merged, as no
part before it can hold more of them, and no read returns them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8


@dataclass(frozen=True)
class Part:
    level: int
    first: int
    last: int
    path: str


class Levels:
    def __init__(self, spark: SparkSession, folder: str, schema, merge: Callable[[DataFrame], DataFrame], live: Column | None = None, fan: int = FAN):
        self.spark, self.folder, self.schema, self.merge, self.live, self.fan = spark, folder.rstrip("/"), schema, merge, live, fan

    # what counts

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        files, path = self._path("manifest")
        found = files.listStatus(path) if files.exists(path) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def _manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"parts": [], "retired": []}
        files, path = self._path(f"manifest/{versions[-1]}")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def parts(self) -> list[Part]:
        """Parts in the order of their batches."""
        return [Part(**p) for p in self._manifest()["parts"]]

    def _swap(self, parts: list[Part], retired: list[str], version: int) -> None:
        files, aside = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps({"parts": [asdict(p) for p in parts], "retired": retired}).encode()))
        out.close()
        files.rename(aside, self._path(f"manifest/{version}")[1])

    def _delete(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    # writing

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> Part:
        part = Part(level, first, last, f"parts/{level}-{first}-{last}")
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part.path}")
        return part

    def _rows(self, parts: list[Part]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{p.path}" for p in parts])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Applies a batch once: ``batch`` has the table's columns but batch_id."""
        before = self._manifest()
        parts = [Part(**p) for p in before["parts"]]
        if parts and parts[-1].last >= batch_id:
            return
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).select(*self.schema.names)
        now = [*parts, self._write(rows, 0, batch_id, batch_id)]
        written, level = [now[-1]], 0
        while len(same := [p for p in now if p.level == level]) >= self.fan:
            merged = self.merge(self._rows(same))
            if self.live is not None and same[0] == now[0]:
                merged = merged.where(self.live)
            made = self._write(merged.select(*self.schema.names), level + 1, same[0].first, same[-1].last)
            now = [p for p in now if p.level > level] + [made]
            written.append(made)
            level += 1
        kept = {p.path for p in now}
        self._swap(now, [p.path for p in parts if p.path not in kept], batch_id)
        # What the manifest before last named may go: a reader that is still at work has the last one.
        for path in [*before["retired"], *(p.path for p in written if p.path not in kept)]:
            self._delete(path)
        for version in self._versions()[:-2]:
            self._delete(f"manifest/{version}")

    def read(self) -> DataFrame:
        """One row per key over all batches."""
        parts = self.parts()
        rows = self._rows(parts) if parts else self.spark.createDataFrame([], self.schema)
        merged = self.merge(rows)
        return merged if self.live is None else merged.where(self.live)


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge: the last written row of every key."""

    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*keys, "batch_id")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"), F.max("batch_id").alias("batch_id"))
        return last.select(*keys, "_v.*", "batch_id")

    return merge
