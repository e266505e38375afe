"""A trie of the prefixes that conversations share, rolled up in bands of depth.

A node of depth d is a distinct sequence of d turns (role and text); its members are the conversations that start
with it. A conversation's prefixes are keyed by running sums: every turn is hashed together with its place, and the
128 bits of a prefix are four 32-bit sums of those hashes. The sums are taken by ``ordered.running_totals``, so a
conversation of any length is dealt over many tasks, and the key of the prefix before is the sum less the turn.

Totals of subtrees go up in two steps. Within a band of ``band`` depths every node adds its values to its ancestors
in the band, at most ``band`` of them. The tops of the bands then form a tree of their own whose depth is ``band``
times smaller; it is rolled up in the same way, and its completed totals are added to the ancestors in the band above.
A node is thus unfolded to at most 2 * ``band`` ancestors, in rounds that grow with the logarithm of the depth.
The ancestors of a node are the prefixes of its smallest member, so they are found by (conversation, band), of which
no group has over ``band`` rows. The root's totals are sums over all nodes, which combine in the map tasks.

Results: turns are in the order of turn (null first), role, the first 64 characters of the text and the turn's hash; a
null role or text is empty; repeated rows are turns like others. Rows without a conversation id belong to none and are left out. No row at all gives the root alone,
without members. Only the columns conv_id, turn, role and text are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ordered import row_position, running_totals

from .graph import stored

BAND = 16
#: Fixed values of the borrowing rule: heads come from each hundredth conversation, and have fewer than six turns.
HEAD_EVERY = 100
HEAD_TURNS = 6
ORDER_CHARS = 64
LANES = ("l0", "l1", "l2", "l3")
NODE = ("depth", "k1", "k2")
#: Ids of a node's last members are joined in blocks of consecutive ids, 4 096 at most.
BLOCK_BITS = 12


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_hash and chars of every turn."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The length of the role tells where the text starts.
    turn_hash = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # The texts stay behind: only the start that orders rows of one number and role is shuffled.
    start = F.substring("text", 1, ORDER_CHARS).alias("start")
    hashed = rows.select("conv_id", "turn", "role", start, turn_hash.alias("turn_hash"), F.length("text").cast("long").alias("chars"))
    return row_position(hashed, ["conv_id"], ["turn", "role", "start", "turn_hash"], "place").select("conv_id", "place", "turn_hash", "chars")


def rebuilt(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation starts with the first turns of the one that its hundred starts with.

    h, the unsigned CRC-32 of the decimal id modulo six, turns are borrowed; the conversation's own first h turns go.
    """
    base = F.col("conv_id") - F.col("conv_id") % HEAD_EVERY
    borrows = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS
    own = places.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.alias("base"), borrows.alias("h"))
    heads = places.where((F.col("conv_id") % HEAD_EVERY == 0) & (F.col("place") < HEAD_TURNS))
    held = own.where((F.col("conv_id") % HEAD_EVERY == 0)).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(
        own.join(held, "base", "left")
        .withColumn("borrowed", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
        .select("conv_id", "base", "h", "borrowed", (F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("n_turns"))
    )
    plan = convs.where("n_turns > 0")
    lent = plan.where("borrowed > 0").join(heads.withColumnRenamed("conv_id", "base"), "base").where("place <= borrowed")
    kept = places.join(plan, "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("borrowed"))
    columns = ["conv_id", F.col("place").alias("depth"), "turn_hash", "chars", (F.col("place") == F.col("n_turns")).alias("last")]
    return lent.select(*columns).unionByName(kept.select(*columns)), convs.select("conv_id", "n_turns")


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, the parent's p1, p2, chars and last of every prefix of every conversation."""
    low = F.lit(0xFFFFFFFF).cast("long")
    hashes = [F.xxhash64(F.lit(k), "depth", "turn_hash") for k in (1, 2)]
    lanes = [part.bitwiseAND(low) for h in hashes for part in (F.shiftrightunsigned(h, 32), h)]
    summed = running_totals(turns.withColumns({f"own_{n}": lane for n, lane in zip(LANES, lanes)}), ["conv_id"], ["depth"], {n: F.col(f"own_{n}") for n in LANES})

    def packed(a: Column, b: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(low), 32).bitwiseOR(b.bitwiseAND(low))

    now, before = ([F.col(n) for n in LANES], [F.col(n) - F.col(f"own_{n}") for n in LANES])
    return summed.select(
        "conv_id", "depth", packed(*now[:2]).alias("k1"), packed(*now[2:]).alias("k2"),
        packed(*before[:2]).alias("p1"), packed(*before[2:]).alias("p2"), "chars", "last",
    )


def rolled_up(nodes: DataFrame, paths: DataFrame, values: list[str], deepest: int, band: int) -> DataFrame:
    """Sums of ``values`` over the subtree of every node, itself included.

    ``nodes`` has level (from 1), k1, k2, the conversation whose prefix the node is, and the values; ``paths`` has
    conv_id, level, k1, k2 of all prefixes. Both are stored tables. Returns level, k1, k2 and the sums.
    """
    at = F.floor((F.col("level") - 1) / band)
    sums = [F.sum(v).alias(v) for v in values]
    above = paths.select("conv_id", at.alias("band"), F.col("level").alias("to"), "k1", "k2")
    below = nodes.select("conv_id", at.alias("band"), "level", *values)
    inside = below.join(above, ["conv_id", "band"]).where("to <= level").select(F.col("to").alias("level"), "k1", "k2", *values)
    inside = inside.groupBy("level", "k1", "k2").agg(*sums)
    if deepest <= band:
        return inside
    inside = stored(inside)
    is_top = (F.col("level") - 1) % band == 0
    up = ((F.col("level") - 1) / band + 1).cast("long").alias("level")
    named = nodes.where(is_top).select("level", "k1", "k2", "conv_id")
    tops = stored(inside.where(is_top).join(named, ["level", "k1", "k2"]).select("conv_id", up, "k1", "k2", *values))
    whole = rolled_up(tops, paths.where(is_top).select("conv_id", up, "k1", "k2"), values, -(-deepest // band), band)
    complete = whole.join(tops.select("level", "k1", "k2", "conv_id"), ["level", "k1", "k2"])
    carried = complete.where("level > 1").select("conv_id", (F.col("level") - 2).alias("band"), *values).join(above, ["conv_id", "band"])
    carried = carried.select(F.col("to").alias("level"), "k1", "k2", *values)
    return inside.unionByName(carried).groupBy("level", "k1", "k2").agg(*sums)


def _digest_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined blocks of each node; rows come ordered by node and block, one batch at a time."""
    node, state = None, None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")))
        done = []
        for *key, ids in rows:
            if key != node:
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield _digests(done)
    if state:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """The digest of the joined ids of the conversations that end at each node.

    A hash of a sequence must be taken in its order, so the ids are first joined in blocks by many tasks. Nodes of one
    block are done then; the blocks of the others pass through one hash each, never together in memory.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = stored(ends.select(*NODE, "conv_id", block.alias("block")).groupBy(*NODE, "block").agg(ids.alias("ids")))
    counts = blocks.groupBy(*NODE).agg(F.count("*").alias("blocks"), F.min("block").alias("block"))
    single = blocks.join(counts.where("blocks = 1").select(*NODE, "block"), [*NODE, "block"]).select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    many = blocks.join(counts.where("blocks > 1").select(*NODE), list(NODE), "left_semi")
    dealt = many.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return single.unionByName(dealt.mapInArrow(_digest_of_blocks, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))


def trie(turns: DataFrame, band: int = BAND, borrow: bool = True) -> DataFrame:
    """One row per node; ``borrow=False`` takes the conversations as they are."""
    places = numbered(turns)
    if borrow:
        rows, convs = rebuilt(places)
    else:
        convs = places.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
        sized = places.join(convs, "conv_id")
        rows = sized.select("conv_id", F.col("place").alias("depth"), "turn_hash", "chars", (F.col("place") == F.col("n_turns")).alias("last"))
    paths = stored(keyed(rows))
    members = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"),
        F.max("chars").alias("chars"), F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2"),
    )
    nodes = stored(
        members.select(
            F.col("depth").alias("level"), "k1", "k2", "p1", "p2", "conv_id", "n_convs",
            # Whoever does not end here goes on to a child.
            F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        )
    )
    all_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    deepest, n_first, *sums = nodes.agg(F.max("level"), F.count_if(F.col("level") == 1), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    totals = rolled_up(nodes, paths.select("conv_id", F.col("depth").alias("level"), "k1", "k2"), ["n_leaves", "saved_tokens"], deepest or 0, band)

    parent = ["level", "k1", "k2"]
    children = nodes.groupBy((F.col("level") - 1).alias("level"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    named = nodes.select("level", F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = (
        nodes.select(*parent, "p1", "p2", "conv_id", "n_convs")
        .join(totals, parent)
        .join(children, parent, "left")
        .join(named.withColumn("level", F.col("level") + 1), ["level", "p1", "p2"], "left")
    )
    root_conv, root_convs = all_convs
    below_root = found.select(
        "conv_id", F.col("level").alias("depth"), "k1", "k2",
        F.when(F.col("level") == 1, F.lit(root_conv)).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
    )
    leaves, saved = sums if n_first else (1, 0)
    root = turns.sparkSession.createDataFrame(
        [(root_conv, 0, 0, 0, None, root_convs, n_first, leaves, saved)],
        "conv_id long, depth long, k1 long, k2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long",
    )
    zero = F.lit(0).cast("long")
    ends = paths.where("last").select(*NODE, "conv_id").unionByName(convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    ended = below_root.unionByName(root).join(ends_digests(ends), list(NODE), "left")
    return ended.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("k1", "k2")


#: DuckDB SQL for the nodes. CRC-32 is spelled out bit by bit; every prefix is unfolded to all its ancestors.
SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
    list_reduce(list_transform(range(9), lambda i: CASE WHEN i = 0 THEN xor(a, b) ELSE i END), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END),
    4294967295::BIGINT) AS v
  FROM (SELECT DISTINCT conv_id FROM t)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc
), counted AS (
  SELECT c.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.base)) AS borrowed FROM convs c
), turns AS (
  SELECT c.conv_id, t.place AS depth, role, text FROM counted c JOIN t ON t.conv_id = c.base AND t.place <= c.borrowed
  UNION ALL SELECT c.conv_id, place - h + borrowed, role, text FROM counted c JOIN t ON t.conv_id = c.conv_id AND place > h
), keyed AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
    depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM turns
), all_rows AS (
  SELECT conv_id, depth, chars, path, last FROM keyed
  UNION ALL SELECT conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM turns WHERE turns.conv_id = convs.conv_id) FROM convs
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, count(*) FILTER (last) AS n_ends,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM all_rows GROUP BY ALL
), up AS (
  SELECT n.*, unnest(range(0, depth + 1)) AS d FROM nodes n
), sums AS (
  SELECT left(path, d * 64) AS path, count(*) FILTER (n_ends = n_convs) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens, count(*) FILTER (d = depth - 1) AS n_children
  FROM up GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, (n.depth - 1) * 64)
"""
