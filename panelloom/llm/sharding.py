"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, bytes are summed per slot, and a versioned
slot-to-shard map, a small table of one row per slot, says where each slot lives.  Rebalancing edits the
map and moves whole slots; records never rehash.

The map is a table in the shared folder (or at ``map_path``, which later runs read again): version 1 deals
the slots out by number, each rebalancing appends a version that moves slots, or swaps two, between the
fullest and the lightest shards, and records are placed by the newest version as it is read back.

Only the per-slot sums (``slots`` rows, a constant) reach the driver, which edits the map.  Records are
joined with the map by broadcast: it has ``slots`` rows at any scale.
A record's position in its shard is the slot's offset plus its rank inside its slot, so no task ever
orders more than one slot.

Defined cases: a null text counts 8 bytes and crc32 0; null ids hash like any value; documents with one
id but different texts, and equal texts with different ids, spread over slots, so no hot key or group of
copies fills a slot; rows equal in id and text are numbered, in any order, and each number has a slot of its
own, so one row that repeats many times spreads like others; an empty
table gives an empty result; clashing column names do not matter, since only the id and text are read.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.common import scratch_root, with_occurrence

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8


def slot_sizes(records: DataFrame) -> DataFrame:
    """Rows (vslot, size) to one row per occupied slot: bytes and rows."""
    return records.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def assign_slots(sizes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """A first map, version 1: (version, vslot, shard), each slot by falling size to the lightest shard."""
    loads = [(0, s) for s in range(shards)]
    placed = []
    for slot in sorted(range(slots), key=lambda v: (-sizes.get(v, 0), v)):
        load, shard = heapq.heappop(loads)
        placed.append((1, slot, shard))
        heapq.heappush(loads, (load + sizes.get(slot, 0), shard))
    return sorted(placed)


def even_map(shards: int = SHARDS, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """A first map, version 1, made before any sizes are known: slots dealt out by number."""
    return [(1, slot, slot % shards) for slot in range(slots)]


def edited_map(current: list[tuple[int, int, int]], sizes: dict[int, int], tolerance: float = 1e-4) -> list[tuple[int, int, int]]:
    """The next version: slots move or swap from the fullest to the lightest shard while that evens the two.

    Ends when shards are within ``tolerance`` of the mean size of each other; a shard that no move makes
    lighter, as it holds a single huge slot, is left as it is.  Without an edit ``current`` is returned.
    """
    version = max(v for v, _, _ in current) + 1
    where = {slot: shard for _, slot, shard in current}
    members: dict[int, list[int]] = {}
    for slot, shard in sorted(where.items()):
        members.setdefault(shard, []).append(slot)
    loads = {s: sum(sizes.get(v, 0) for v in m) for s, m in members.items()}
    enough, open_ = tolerance * sum(loads.values()) / max(len(loads), 1), set(loads)
    while len(open_) > 1:
        full, light = max(open_, key=lambda s: (loads[s], -s)), min(open_, key=lambda s: (loads[s], s))
        gap = loads[full] - loads[light]
        if gap <= enough:
            break
        out = np.array([sizes.get(v, 0) for v in members[full]], np.int64)
        back = np.array([0, *(sizes.get(v, 0) for v in members[light])], np.int64)  # 0: nothing comes back
        moved = out[:, None] - back[None, :]
        cost = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), gap)
        i, j = np.unravel_index(int(cost.argmin()), cost.shape)
        if cost[i, j] >= gap:
            open_.remove(full)
            continue
        slot = members[full].pop(int(i))
        if j:
            other = members[light].pop(int(j) - 1)
            members[full].append(other)
            where[other] = full
        members[light].append(slot)
        where[slot] = light
        loads[full] -= int(moved[i, j])
        loads[light] += int(moved[i, j])
    placed = sorted((version, slot, shard) for slot, shard in where.items())
    return placed if [p[1:] for p in placed] != [p[1:] for p in sorted(current)] else current


def grow_map(current: list[tuple[int, int, int]], sizes: dict[int, int], shards: int) -> list[tuple[int, int, int]]:
    """The next version, for one more shard: slots move only to the new shard, from the fullest shards."""
    version = max(v for v, _, _ in current) + 1
    where = {slot: shard for _, slot, shard in current}
    goal = sum(sizes.values()) / (shards + 1)
    loads = {s: 0 for s in range(shards)}
    members: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in where.items():
        loads[shard] += sizes.get(slot, 0)
        members[shard].append(slot)
    for shard in members:
        members[shard].sort(key=lambda v: (-sizes.get(v, 0), v))
        for slot in members[shard]:
            size = sizes.get(slot, 0)
            if size and loads[shard] - size >= goal * 0.999:
                where[slot] = shards
                loads[shard] -= size
    return sorted((version, slot, shard) for slot, shard in where.items())


def map_table(spark: SparkSession, placed: list[tuple[int, int, int]]) -> DataFrame:
    """The stored form of a map: version, vslot, shard; append new versions, read the largest."""
    return spark.createDataFrame(placed, "version int, vslot int, shard int")


def store_map(spark: SparkSession, path: str, placed: list[tuple[int, int, int]]) -> None:
    """Append a version; earlier ones stay readable."""
    map_table(spark, placed).coalesce(1).write.mode("append").parquet(path)


def stored_map(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """The newest version at ``path`` (one row per slot); empty if nothing is stored there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return []
    kept = spark.read.schema("version int, vslot int, shard int").parquet(path)
    newest = kept.filter(F.col("version") == kept.agg(F.max("version")).first()[0])
    return sorted(map(tuple, newest.collect()))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    The law is ``bytes``: the map is edited by the slots' bytes, so shards are near equal in size.
    ``slot`` is the document's position in its shard, gapless from 0.  With ``map_path`` the stored map is
    the one to edit, so that a corpus that has grown moves few slots; else a new one is begun.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    records = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("place"),
    )
    records = with_occurrence(records, F.col("place"), F.col("size"), F.col("text_crc32"))
    repeat = F.when(F.col("occurrence") > 0, F.xxhash64("place", "occurrence")).otherwise(F.col("place"))
    records = records.withColumn("vslot", F.pmod(repeat, F.lit(slots)).cast("int")).drop("place", "occurrence")
    found = {r.vslot: r for r in slot_sizes(records).collect()}  # at most ``slots`` rows
    sizes = {v: r.slot_bytes for v, r in found.items()}
    path = map_path or f"{scratch_root(spark)}/slot-map-{uuid.uuid4().hex}"
    current = stored_map(spark, path)
    if not current:
        current = even_map(shards, slots)
        store_map(spark, path, current)
    if len(current) != slots:
        raise ValueError(f"the map at {path} has {len(current)} slots, not {slots}")
    for _ in range(shards - 1 - max(shard for _, _, shard in current)):
        current = grow_map(current, sizes, max(shard for _, _, shard in current) + 1)
        store_map(spark, path, current)
    edited = edited_map(current, sizes)
    if edited is not current:
        store_map(spark, path, edited)
    offsets, filled = [], {}
    for version, vslot, shard in stored_map(spark, path):
        offsets.append((version, vslot, shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + (found[vslot].slot_rows if vslot in found else 0)
    where = spark.createDataFrame(offsets, "map_version int, vslot int, shard int, first_slot long")
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(where), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_slot") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )
