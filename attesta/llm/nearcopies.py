"""Near copies by their sets of five-word shingles: SimHash finds candidates, bands the rest, the sets themselves decide.

Two texts are near copies if their sets of shingles have a Jaccard similarity of 0.8 or more. SimHash comes first: the
fingerprint of a set is the majority of its hashes, ``simhash.links`` finds all fingerprints within three bits by its
BK-trees, and the sets of a class of fingerprints are a bucket of candidates. Pairs of similarity 0.8 may differ in ten
bits, though, and blocks that pairs so far apart must share are a few bits wide. So the sets that are not in one class
after that are sought by bands of minimum hashes: a band is four minima, a set has 25 bands, and a pair of similarity
0.8 shares none of them with a probability of 2 in a million (independent hashes assumed).

A bucket holds the sets of a class of fingerprints, or those that share a band; buckets with the same members are searched once. In a bucket every two
sets that are not yet linked are compared, so its classes are those of all its pairs. A bucket with many shingles is
dealt into parts; what is not in its largest class after that goes to all of its parts once more.

Results: words are cut as for the fingerprint; a text of fewer words is one shingle; null and empty texts are one
class. Equal sets are one node, and classes are linked pairs and all that they reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, stored
from .simhash import links as fingerprint_links
from .simhash import majority

SEED = 42
SHINGLE_WORDS = 5
SIMILAR = (4, 5)  # similarity 0.8 as a fraction
BANDS = 25
BAND_HASHES = 4
SHINGLES_PER_BLOCK = 4_096
PART_SHINGLES = 2_000_000


def shingles(text: str | None) -> np.ndarray:
    """The different hashes of the text's shingles, ascending."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, "<u8")
    n, joined = min(SHINGLE_WORDS, len(words)), b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), "<u8", len(starts)))


def factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, (BANDS * BAND_HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(found: np.ndarray, odd: np.ndarray) -> list[int]:
    """Signed hashes of the bands of a set; none of an empty one."""
    if not len(found):
        return []
    least = np.full(len(odd), 2**64 - 1, np.uint64)
    for k in range(0, len(found), SHINGLES_PER_BLOCK):
        np.minimum(least, (found[k : k + SHINGLES_PER_BLOCK] * odd).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_HASHES)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - 2**63 for band, row in enumerate(rows)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets are near copies."""
    if len(a) > len(b):
        a, b = b, a
    over, under = SIMILAR
    if under * len(a) < over * len(b):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return under * common >= over * (len(a) + len(b) - common)


def linked(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of near copies. Pairs within a class found so far are not compared."""
    classes: list[list[int]] = []
    for i, own in enumerate(sets):
        joined = [i]
        rest = []
        for members in classes:
            mate = next((m for m in members if similar(own, sets[m])), None)
            if mate is None:
                rest.append(members)
            else:
                yield i, mate
                joined = members + joined if len(members) > len(joined) else joined + members
        classes = [*rest, joined]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (the hash of the set), number of shingles, fingerprint and band keys of every row."""
    names = ["doc_id", "text_hash", "node", "n", "fp", "keys"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = factors()
        for batch in batches:
            made = []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                blocks = (found[k : k + SHINGLES_PER_BLOCK] for k in range(0, len(found), SHINGLES_PER_BLOCK))
                made.append((xxhash.xxh64_intdigest(found.tobytes(), SEED) - 2**63, len(found), majority(blocks), band_keys(found, odd)))
            new = [pa.array((m[k] for m in made), kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *new], names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, node bigint, n bigint, fp bigint, keys array<bigint>")


def _search(cells: DataFrame) -> DataFrame:
    """Edges (a, b) within each (key, part) of ``cells``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []

        def edges() -> pa.RecordBatch:
            pairs = list(linked(sets))
            return pa.RecordBatch.from_arrays([pa.array((nodes[i] for i, _ in pairs), pa.int64()), pa.array((nodes[j] for _, j in pairs), pa.int64())], ["a", "b"])

        for batch in batches:
            for key, part, node, text in zip(*(batch.column(c) for c in ("key", "part", "node", "text"))):
                at = key.as_py(), part.as_py()
                if at != cell:
                    if len(nodes) > 1:
                        yield edges()
                    cell, nodes, sets = at, [], []
                nodes.append(node.as_py())
                sets.append(shingles(text.as_py()))
        if len(nodes) > 1:
            yield edges()

    dealt = cells.select("key", "part", "node", "text").repartition("key", "part")
    return dealt.sortWithinPartitions("key", "part", "node").mapInArrow(task, "a bigint, b bigint")


def fingerprint_buckets(nodes: DataFrame) -> DataFrame:
    """node, n and key, the class of the node's fingerprint, of every set that is not empty."""
    full = nodes.where("n > 0").select("node", "n", "fp")
    near = components(fingerprint_links(stored(full.select("fp").distinct())), "a", "b")
    classed = full.join(near.select(F.col("node").alias("fp"), F.col("root").alias("class")), "fp", "left")
    return classed.select("node", "n", F.xxhash64(F.lit("fingerprint"), F.coalesce("class", "fp")).alias("key"))


def links(docs: DataFrame, rows: DataFrame, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Edges (a, b) between the nodes of ``rows``, the sketches of ``docs``, whose components are the classes of near copies."""
    nodes = stored(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", "keys")), F.min("text_hash").alias("text_hash")))
    first = within(docs, nodes, fingerprint_buckets(nodes).withColumn("known", F.col("node")), part_shingles)
    # What SimHash has linked is one class; bands are searched for what is not.
    found = components(first, "a", "b").withColumnRenamed("root", "known")
    classed = nodes.join(found, "node", "left").withColumn("known", F.coalesce("known", "node"))
    return first.union(within(docs, nodes, classed.select("node", "n", "known", F.explode("keys").alias("key")), part_shingles))


def within(docs: DataFrame, nodes: DataFrame, keyed: DataFrame, part_shingles: int) -> DataFrame:
    """Edges (a, b) that link the near copies of each bucket; ``keyed`` has node, n, key and the class ``known`` so far."""
    sums = F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("who")
    buckets = keyed.groupBy("key").agg(*sums, F.min("known").alias("low"), F.max("known").alias("high")).where("low < high")
    once = buckets.groupBy("members", "total", "who").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("total") / part_shingles).cast("int").alias("parts")
    members = stored(keyed.join(once.select("key", parts), "key").select("key", "node", "parts"))
    wanted = nodes.select("node", "text_hash").join(members.select("node").distinct(), "node", "left_semi")
    given = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    texts = stored(given.join(wanted, "text_hash").groupBy("node").agg(F.first("text").alias("text")))
    own = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    first = stored(_search(members.withColumn("part", own).join(texts, "node")))
    wide = members.where("parts > 1")
    if wide.isEmpty():
        return first
    # Parts of one bucket meet here: all but the bucket's largest class goes to each of them.
    roots = components(first, "a", "b").withColumnRenamed("root", "class")
    classed = stored(wide.join(roots, "node", "left").withColumn("class", F.coalesce("class", "node")))
    largest = classed.groupBy("key", "class").count().groupBy("key").agg(F.max_by("class", F.struct("count", "class")).alias("most"))
    everywhere = F.when(F.col("class") == F.col("most"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    again = classed.join(largest, "key").select("key", "node", F.explode(everywhere).alias("part"))
    return first.union(stored(_search(again.join(texts, "node"))))


def classes(docs: DataFrame, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """doc_id, text_hash and root (the same for all of a class of near copies) of every row."""
    rows = stored(sketches(docs))
    found = components(links(docs, rows, part_shingles), "a", "b")
    return rows.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
