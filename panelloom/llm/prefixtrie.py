"""The trie of conversation prefixes by prefix-doubling names.

Turns get dense names (whole numbers without gaps) by role and text.  Blocks of 2, 4, 8, ... turns are named by
the pair of names of their halves, in one grouping and one join for each power of two.  A prefix of any length
is then named by its binary decomposition: from the largest power down, the prefix that is there already and the
block that comes next make a pair, and equal pairs get one name, which is the node.  So the rounds grow with the
logarithm of the longest conversation, and every round but the first moves whole numbers only.

Sums over subtrees need no walk either: a node belongs to its smallest member, whose later prefixes lie below
it.  What a conversation owns is summed from its end upwards, and the sums of all members meet at the node.

Hot groups: a turn or prefix that a third of all conversations share is aggregated before it is shuffled, and its
names go back by joins that adaptive execution splits.  A conversation with a third of all turns is sorted over
many partitions; what comes before each is an offset, of which there are fewer than partitions, so these are
broadcast.  The ids that end at a node are hashed as a stream, sorted in the shuffle; a hash is a chain, so one
task reads a node's ids, but never holds them.  Rounds are written to the shared folder; counts of names and the
length of the longest conversation are all that the driver sees.

Results: a null role or text is empty; turns are ordered null first, equal turns by role, then text; rows without
conv_id belong to no conversation and are left out; empty and very long texts are turns like others; repeated
rows are further turns; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import bound_batches, dropped, word_count, written

#: How far monotonically_increasing_id moves the number of the partition.
_PART = 33


def sorted_parts(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """``df`` written in the order of key and ``order``, with the partition (part) and place (at) of each row."""
    laid = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    return written(laid.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")


def running_sums(laid: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Adds for each row of :func:`sorted_parts` the sums of all rows of its key up to it.

    Sums run within a key's share of a partition; a key in several partitions gets the rest by an offset.  Each
    border between partitions lies in one key at most, so offsets are fewer than partitions.
    """
    totals = laid.groupBy(key, "part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "part", *[F.sum(n).over(before).alias(f"{n}_before") for n in sums]).filter(" or ".join(f"{n}_before is not null" for n in sums))
    within = Window.partitionBy(key, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    out = out.join(F.broadcast(offsets), [key, "part"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) for n in sums}).drop("part", "at", *[f"{n}_before" for n in sums])


def dense_names(rows: DataFrame, keys: list[str], first: int, *aggregates: Column) -> DataFrame:
    """One row per distinct ``keys`` with ``aggregates`` and its ``name``, a whole number without gaps from ``first``.

    Rows are numbered within the partitions of a written table, whose sizes (a row each) give the offsets.
    """
    made = written(rows.groupBy(*keys).agg(*(aggregates or (F.count(F.lit(1)).alias("n_rows"),))).withColumn("id", F.monotonically_increasing_id()), "names")
    sizes = made.groupBy(F.shiftright("id", _PART).alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", (before + first).alias("start"))
    place = F.col("id").bitwiseAND(F.lit((1 << _PART) - 1))
    return made.withColumn("part", F.shiftright("id", _PART)).join(F.broadcast(starts), "part").withColumn("name", F.col("start") + place).drop("id", "part", "start")


def named_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, name, words): turns in order from 0, the name of role and text, and the text's words."""
    texts = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    laid = sorted_parts(texts, "conv_id", F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    names = dense_names(laid, ["role", "text"], 0).withColumn("words", word_count(F.col("text")))
    slim = laid.join(names, ["role", "text"]).select("conv_id", "part", "at", "name", "words")
    numbered = running_sums(slim, "conv_id", {"count": F.lit(1)})
    return written(numbered.select("conv_id", (F.col("count") - 1).cast("long").alias("pos"), "name", "words"), "turns")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations, as turns and ids: conversation c begins with h turns of the multiple of 20 at or below c, h by c's checksum.

    It goes on with its own turns after its first h.  Heads are three turns at most, copied to at most twenty ids.
    """
    n_turns = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = n_turns.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(20))).alias("base"))
    there = n_turns.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = written(heads.join(there, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))), "heads")
    lent = turns.filter("conv_id % 20 = 0 and pos < 3").withColumnRenamed("conv_id", "base")
    first = heads.filter("head > 0").join(lent, "base").filter("pos < head").select("conv_id", "pos", "name", "words")
    rest = turns.join(heads, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "name", "words")
    return written(first.unionByName(rest), "rebuilt"), heads.select("conv_id")


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the hash of a node's ids, ascending, comma-joined."""
    bound_batches(ends.sparkSession)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()

        def out(nodes, hashes):
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])

        for b in batches:
            nodes, ids = (c.to_numpy() for c in b.columns)
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
            done: tuple[list[int], list[str]] = [], []
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                text = ",".join(map(str, ids[a:z].tolist()))
                if node == nodes[a]:
                    digest.update(f",{text}".encode())
                    continue
                if node is not None:
                    done[0].append(node)
                    done[1].append(digest.hexdigest())
                node, digest = int(nodes[a]), hashlib.sha256(text.encode())
            yield out(*done)
        if node is not None:
            yield out([node], [digest.hexdigest()])

    return ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(batch, "node long, ends_sha256 string")


def node_names(turns: DataFrame, ids: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of nodes (node, conv_id, depth, n_convs) and of every conversation's prefixes (conv_id, depth, node, owner).

    ``turns`` has conv_id, pos from 0 without gaps and name; ``ids`` all conversations, turnless ones too.
    """
    longest = turns.agg(F.max("pos")).first()[0]
    blocks = [turns.select("conv_id", "pos", "name")]
    for _ in range(1, 0 if longest is None else (longest + 1).bit_length()):
        odd = F.col("pos") % 2 == 1
        halves = [F.max(F.when(side, F.col("name"))).alias(n) for side, n in ((~odd, "a"), (odd, "b"))]
        pairs = written(blocks[-1].groupBy("conv_id", F.shiftright("pos", 1).alias("pos")).agg(*halves).filter("b is not null"), "pairs")
        names = dense_names(pairs, ["a", "b"], 0)
        blocks.append(written(pairs.join(names, ["a", "b"]).select("conv_id", "pos", "name"), "blocks"))
        dropped(pairs)
    least, count = ids.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    root = ids.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(count).cast("long").alias("n_convs"))
    nodes = [root.filter(F.lit(count > 0))]
    prefixes = [ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"), F.lit(least).cast("long").alias("owner"))]
    first = 1
    for k in reversed(range(len(blocks) if longest is not None else 0)):
        step = 1 << k
        then = blocks[k].filter("pos % 2 = 0").select("conv_id", (F.col("pos") * step).alias("depth"), F.col("name").alias("block"))
        longer = written(reduce(DataFrame.unionByName, prefixes).join(then, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + step).alias("depth"), "node", "block"), "longer")
        made = dense_names(longer, ["node", "block"], first, F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("deep"))
        prefixes.append(written(longer.join(made, ["node", "block"]).select("conv_id", "depth", F.col("name").alias("node"), "owner"), "prefixes"))
        nodes.append(made.select(F.col("name").alias("node"), F.col("owner").alias("conv_id"), F.col("deep").alias("depth"), "n_convs"))
        first += made.count()
        dropped(longer)
        if k:
            dropped(blocks[k])
    return nodes, prefixes


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node: smallest member, depth, parent, members, children, leaves and tokens saved below, digest of ends."""
    nodes, prefixes = (reduce(DataFrame.unionByName, x) for x in node_names(turns, ids))
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    words = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    own = written(nodes.join(above, ["conv_id", "depth"], "left").join(words, ["conv_id", "depth"], "left"), "nodes")
    children = own.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = own.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = written(own.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))}), "nodes")
    carried = prefixes.select("conv_id", "depth", "node").join(own.select("conv_id", "depth", "leaf", "saved"), ["conv_id", "depth"], "left")
    laid = sorted_parts(carried.fillna(0, ["leaf", "saved"]), "conv_id", F.col("depth").desc())
    below = running_sums(laid, "conv_id", {"leaves": F.col("leaf"), "tokens": F.col("saved")}).groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("last")).select("last.node", "conv_id")
    out = own.join(below, "node").join(_digests(last), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    return prefix_trie(*shared_heads(named_turns(conversations)))


_STEP = "xor(a >> 1, 3988292384 * (a & 1))"
TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - (conv_id % 20 + 20) % 20 AS base, count(*) AS n,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: {_STEP})), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY conv_id),
heads AS (SELECT ids.*, least(ids.h, coalesce(b.n, 0)) AS head FROM ids LEFT JOIN ids b ON b.conv_id = ids.base),
turns AS (
  SELECT heads.conv_id, pos, role, text FROM heads JOIN t ON t.conv_id = base AND pos < head
  UNION ALL SELECT heads.conv_id, pos - h + head, role, text FROM heads JOIN t ON t.conv_id = heads.conv_id AND pos >= h),
paths AS (
  SELECT conv_id, pos + 1 AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM paths GROUP BY path, depth),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT path, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM paths JOIN lengths USING (conv_id, depth) GROUP BY path, depth),
edges AS (
  SELECT c.path, c.depth, p.path AS parent, p.conv_id AS parent_conv_id
  FROM nodes c JOIN paths q ON q.conv_id = c.conv_id AND q.depth = c.depth - 1 JOIN nodes p ON p.path = q.path AND p.depth = q.depth),
children AS (SELECT parent AS path, depth - 1 AS depth, count(*) AS n FROM edges GROUP BY ALL),
below AS (
  SELECT a.path, a.depth, sum(b.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes a JOIN nodes b ON b.depth >= a.depth AND starts_with(b.path, a.path) LEFT JOIN children k ON k.path = b.path AND k.depth = b.depth
  GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, e.parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, sha256(coalesce(s.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (path, depth) LEFT JOIN edges e USING (path, depth) LEFT JOIN children k USING (path, depth) LEFT JOIN ends s USING (path, depth)
"""
