"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Fingerprints within three bits of each other agree on one of four 16-bit blocks and, there, on one of four
12-bit parts of the rest. These 28-bit keys are the shards. Each shard with two or more different
fingerprints gets a BK-tree: children are keyed by their distance to the parent, and a search follows only
edges within the radius of the distance that it stands at. A shard over ``TREE_NODES`` fingerprints is
dealt into parts, and the tree of each part is sent to the searches of every other part by the shuffle.
That is how trees are broadcast here: a tree has a bound, while all trees together grow with the corpus
and must not pass through the driver. A task returns a spanning forest of its shard instead of pairs.

Results: a null or empty text has fingerprint zero and is linked like any other; a null doc_id counts as no
id, and a class without ids has a null component_id. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, stored

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
TREE_NODES = 8_192
SHINGLES_PER_BLOCK = 100_000
VISITS_PER_BLOCK = 500_000


def fingerprint(text: str | None) -> int:
    """Signed 64 bits; bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = min(SHINGLE_WORDS, len(words))
    starts, ends = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    spans = (slice(k, k + SHINGLES_PER_BLOCK) for k in range(0, len(starts), SHINGLES_PER_BLOCK))
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[span], ends[span])], "<u8") for span in spans)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """Signed 64 bits; bit i is set if it is set in over half of the hashes of all blocks."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in blocks:
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # so many fit in the sums of bytes
            counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fingerprint of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array((fingerprint(t.as_py()) for t in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), made], ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def shard_keys(fp: str) -> Column:
    """The sixteen (block, part) keys of a fingerprint."""
    keys = []
    for i in range(4):
        turned = F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i)) if i else F.col(fp)
        block = F.shiftleft(F.shiftrightunsigned(turned, 48), 12)
        for j in range(4):
            part = F.shiftrightunsigned(turned, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + j) << 28).bitwiseOR(block).bitwiseOR(part))
    return F.array(*keys)


class Forest:
    """One BK-tree for each shard of a block of rows, built and searched level by level.

    ``edges`` holds parent * 65 + distance, ascending, and ``children`` the node below each edge.
    """

    def __init__(self, shards: np.ndarray, fps: np.ndarray):
        self.fps = fps
        _, first, own = np.unique(shards, return_index=True, return_inverse=True)
        self.root = first[own]
        edges, children = [], []
        at, left = self.root.copy(), np.flatnonzero(self.root != np.arange(len(fps)))
        while len(left):
            edge = at[left] * 65 + np.bitwise_count(fps[left] ^ fps[at[left]])
            made, pick, own = np.unique(edge, return_index=True, return_inverse=True)
            child = left[pick]
            edges.append(made)
            children.append(child)
            at[left] = child[own]
            left = left[child[own] != left]
        if edges:
            edges, children = np.concatenate(edges), np.concatenate(children)
            order = np.argsort(edges)
            self.edges, self.children = edges[order], children[order]
        else:
            self.edges = self.children = np.zeros(0, np.int64)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs at most ``radius`` apart, in blocks of bounded size."""
        waiting = [(queries[k : k + VISITS_PER_BLOCK], self.root[queries[k : k + VISITS_PER_BLOCK]]) for k in range(0, len(queries), VISITS_PER_BLOCK)]
        while waiting:
            query, node = waiting.pop()
            apart = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
            near = (apart <= radius) & (query != node)
            yield query[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(apart - radius, 0))
            count = np.searchsorted(self.edges, node * 65 + np.minimum(apart + radius, 64), side="right") - low
            for k in _cuts(count, VISITS_PER_BLOCK):
                n = count[k]
                below = np.repeat(low[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if len(below):
                    waiting.append((np.repeat(query[k], n), self.children[below]))


def _cuts(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``count`` that sum to about ``most``."""
    group = np.cumsum(count) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(count)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def forest_links(shards: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with the first one of its component in its shard, where that is another."""
    top = np.arange(len(fps))
    for u, v in Forest(shards, fps).within(np.arange(len(fps)), radius):
        while len(u):
            ru, rv = top[u], top[v]
            other = ru != rv
            u, v, ru, rv = u[other], v[other], ru[other], rv[other]
            np.minimum.at(top, np.maximum(ru, rv), np.minimum(ru, rv))
            while (top != top[top]).any():
                top = top[top]
    linked = np.flatnonzero(top != np.arange(len(fps)))
    return fps[linked], fps[top[linked]]


def links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of different fingerprints within ``radius`` (3 at most)."""
    if radius > 3:
        raise ValueError("the shard keys find pairs of at most 3 differing bits")
    keyed = fps.select("fp", F.explode(shard_keys("fp")).alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree_nodes).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))
    dealt = keyed.join(full, "key").select("key", "fp", parts.alias("parts")).select("key", "fp", own.alias("own"), other.alias("other"))
    cells = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "low", "high", "fp")])
            rest = now if rest is None else np.concatenate([rest, now], axis=1)
            ends = np.flatnonzero((np.diff(rest[:3], axis=1) != 0).any(axis=0))
            if len(ends):  # the last shard may go on in the next batch
                yield _linked(rest[:, : ends[-1] + 1], radius)
                rest = rest[:, ends[-1] + 1 :]
        if rest is not None:
            yield _linked(rest, radius)

    return cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp").mapInArrow(task, "a bigint, b bigint")


def _linked(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    changes = np.concatenate([[0], np.cumsum((np.diff(rows[:3], axis=1) != 0).any(axis=0))])
    a, b = forest_links(changes, rows[3].view(np.uint64), radius)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp and component_id (the smallest doc_id of its class) of every row."""
    rows = stored(fingerprints(docs))
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(fps, radius), "a", "b")
    rooted = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(classes, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies (``nearcopies``), with its columns: that of the smallest doc_id, nulls last.

    Of rows with that doc_id the smallest text hash stays, and of equal rows any one.
    """
    from . import nearcopies  # which builds on the fingerprints and links of this module

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    chosen = nearcopies.classes(docs).groupBy("root").agg(first)
    # One row of each text and id in a class, so one entry; two classes never share a text.
    chosen = chosen.select(F.col("first.text_hash").alias("_attesta_hash"), F.coalesce("first.doc_id", F.lit(0)).alias("_attesta_id"), F.col("first.no_id").alias("_attesta_none"))
    keys = {"_attesta_hash": F.xxhash64("text"), "_attesta_id": F.coalesce("doc_id", F.lit(0)), "_attesta_none": F.col("doc_id").isNull()}
    rows = docs.withColumns(keys).join(chosen, list(keys), "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return rows.withColumn("_attesta_place", place).where("_attesta_place = 1").drop("_attesta_place", *keys)
