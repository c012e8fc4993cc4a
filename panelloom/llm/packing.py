"""Packing documents into sequences by bulk-synchronous best-fit.

Texts become token ids, with an id that ends each document; documents longer than a sequence are cut, the first
piece being the shorter one.  Full pieces are sequences already.  The others are packed in rounds:

1. Pieces and the gaps of open sequences are sorted by range together, largest first, gaps before pieces.
2. Each partition sweeps its rows: a piece takes the last gap before it that is free, the smallest that holds it.
3. What a partition leaves are pieces, then gaps.  Counts per partition say which leftover piece meets which
   leftover gap of an earlier partition, by their ranks; one join on partition and rank brings them together.
4. Gaps shrink by what they took, and the next round begins.  Gaps that no piece fits are closed.

New sequences are opened for the largest pieces left only, where these are more than the gaps hold, and as many as
the excess needs at least.  A gap that holds several of the largest pieces left is offered in several
parts at once, and so takes several pieces in a round, so many small pieces need few rounds.

The driver sees two histograms a round, of at most as many rows as a sequence has tokens, and three numbers per
partition.  Sizes are sorted with ids behind them, so equal sizes spread over partitions, and a sequence's rows
are at most its tokens.  Every round is written to the shared folder.  A task holds three numbers for each row
of its partition.

Texts are encoded in tasks, each whole, by a tokenizer whose file every machine has at the same path.

Results: a null or empty text is the end id alone; long texts are encoded whole; equal rows are packed each for
itself, and which of them lies where is left open; an empty table gives an empty table; other columns are not
read, whatever their names.  Reruns over the same files give the same packing up to the order of equal sizes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import bound_batches, dropped, written

CAPACITY = 2048
END = 0
#: Fixed value: how a byte-level tokenizer of this kind cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from which a text is left to the slower of two libraries with the same ids, as the faster one recurses.
LONG = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts by the tokenizer at ``path``, four bytes each.

    The tokenizer's own vocabulary, whose ids are in the order of its merges, also serves a faster library with the same
    ids.  Texts with one of its special tokens, and very long ones, go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): k for token, k in self.whole.get_vocab().items() if token not in self.special}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        slow = len(text) >= LONG or any(t in text for t in self.special)
        ids = self.whole.encode(text, add_special_tokens=False).ids if slow else self.fast(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bounds(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` ids begin, and ``n``: all are full but, at most, the first."""
    return [0, *range(n % capacity or min(n, capacity), n, capacity), n]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document's ids, ``end`` last."""
    bound_batches(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "") + last
                at = bounds(len(ids) // 4, capacity)
                rows += [(k, p, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for p, (a, z) in enumerate(zip(at, at[1:], strict=False))]
            row, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batch, PIECES)


def sweep(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in falling size: places of gaps and of the pieces that take them, then of pieces and of gaps left.

    A piece takes the last free gap before it, as a closing bracket meets the last open one.
    """
    depth = np.cumsum(np.where(is_gap, 1, -1))
    order = np.argsort(np.where(is_gap, depth, depth + 1), kind="stable")
    level, gap = np.where(is_gap, depth, depth + 1)[order], is_gap[order]
    pair = np.flatnonzero(gap[:-1] & ~gap[1:] & (level[:-1] == level[1:]))
    gaps, pieces = order[pair], order[pair + 1]
    free = np.ones(len(is_gap), bool)
    free[gaps] = free[pieces] = False
    return gaps, pieces, np.flatnonzero(free & ~is_gap), np.flatnonzero(free & is_gap)


def meetings(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (partition, pieces left, gaps left): (partition, first rank, ranks, partition of gaps, gap rank of the first).

    Leftover pieces take the last leftover gaps of earlier partitions, ranks of gaps falling from there.
    """
    free: list[list[int]] = []
    out = []
    for part, pieces, gaps in sorted(left):
        rank = 0
        while rank < pieces and free:
            other, there = free[-1]
            n = min(there, pieces - rank)
            out.append((part, rank, n, other, there - 1))
            rank += n
            free[-1][1] -= n
            if not free[-1][1]:
                free.pop()
        if gaps:
            free.append([part, gaps])
    return out


_SWEPT = "item long, size long, bin long, slot long, room long, part int, rank long"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    ids, slot, amount, is_gap = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(4))
    gaps, pieces, alone, free = sweep(is_gap)
    part = TaskContext.get().partitionId()

    def rows(p, g, rank):
        n = len(g) if p is None else len(p)
        none = pa.nulls(n, pa.int64())
        piece = (none, none) if p is None else (pa.array(ids[p]), pa.array(amount[p]))
        gap = (none, none, none) if g is None else (pa.array(ids[g]), pa.array(slot[g]), pa.array(amount[g]))
        return pa.RecordBatch.from_arrays([*piece, *gap, pa.array(np.full(n, part, np.int32)), none if rank is None else pa.array(rank)], names=["item", "size", "bin", "slot", "room", "part", "rank"])

    yield rows(pieces, gaps, None)
    yield rows(alone, None, np.arange(len(alone)))
    yield rows(None, free, np.arange(len(free)))


def _histogram(df: DataFrame, column: str) -> dict[int, int]:
    """Rows by size: at most as many entries as a sequence has tokens."""
    return {r[0]: r[1] for r in df.groupBy(column).agg(F.count(F.lit(1))).collect()}


def openings(pieces: dict[int, int], gaps: dict[int, int], capacity: int, small: int = 4) -> int:
    """How many sequences must be opened at least for pieces of these sizes beside these gaps.

    While fewer than ``small`` of the largest pieces fill a sequence, for these alone, by their number: those of
    which as many fit into a sequence; a gap holds as many pieces of a size or more as it holds of that size.
    After that for all pieces by their tokens: pieces of a size or more go into gaps of that size or more.
    """
    each = capacity // max(pieces)
    most = held = 0
    for size in sorted(pieces, reverse=True):
        if each < small and capacity // size > each:
            break
        wide = [(g, n) for g, n in gaps.items() if g >= size]
        if each < small:
            held += pieces[size]
            need = (held - sum(g // size * n for g, n in wide)) / each
        else:
            held += size * pieces[size]
            need = (held - sum(g * n for g, n in wide)) / capacity
        most = max(most, math.ceil(need))
    return most


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, bin, offset) for rows (item, size) with distinct items and sizes of 1 to ``capacity``: few bins, from 0."""
    spark = items.sparkSession
    bound_batches(spark)
    gaps = spark.range(0).select(F.col("id").alias("bin"), F.col("id").alias("gap"))
    rounds: list[DataFrame] = []
    opened, sizes, open_gaps = 0, _histogram(items, "size"), {}
    while sizes:
        largest, least, n_items = max(sizes), min(sizes), sum(sizes.values())
        new = openings(sizes, open_gaps, capacity)
        gaps = gaps.filter(F.col("gap") >= least)
        if new:
            gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap")))
        opened += new
        n_gaps = new + sum(n for g, n in open_gaps.items() if g >= least)
        parts = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / largest), F.lit(math.ceil(2 * n_items / n_gaps)))).cast("long")
        slots = gaps.withColumn("parts", parts).select("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("slot"), "gap", "parts")
        room = F.when(F.col("slot") == 0, F.col("gap") - (F.col("parts") - 1) * largest).otherwise(F.lit(largest))
        slots = slots.select(F.col("bin").alias("id"), "slot", room.cast("long").alias("amount"), F.lit(True).alias("gap"))
        rows = slots.unionByName(items.select(F.col("item").alias("id"), F.lit(0).cast("long").alias("slot"), F.col("size").alias("amount"), F.lit(False).alias("gap")))
        order = (F.col("amount").desc(), F.col("gap").desc(), F.col("id"), F.col("slot"))
        swept = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_swept, _SWEPT), "swept")
        left = swept.filter("rank is not null").groupBy("part").agg(F.count("item"), F.count("bin")).collect()
        met = meetings([tuple(r) for r in left])
        alone, free = swept.filter("bin is null").drop("bin", "slot", "room"), swept.filter("item is null").drop("item", "size")
        table = spark.createDataFrame(met, "part int, low long, n long, gap_part int, gap_rank long")
        paired = alone.join(F.broadcast(table), (alone.part == table.part) & (alone.rank >= table.low) & (alone.rank < table.low + table.n), "left")
        paired = paired.select("item", "size", F.col("gap_part").alias("part"), (F.col("gap_rank") - (alone.rank - F.col("low"))).alias("rank"))
        columns = ("item", "size", "bin", "slot", "room")
        both = free.join(paired.filter("part is not null"), ["part", "rank"], "left").select(*columns)
        none = F.lit(None).cast("long")
        unmet = paired.filter("part is null").select("item", "size", none.alias("bin"), none.alias("slot"), none.alias("room"))
        now = written(swept.filter("rank is null").select(*columns).unionByName(both).unionByName(unmet), "round")
        dropped(swept)
        rounds.append(now.filter("item is not null and bin is not null").select("item", "bin", "size", F.lit(len(rounds)).alias("round"), "slot"))
        items = now.filter("bin is null").select("item", "size")
        gaps = now.filter("bin is not null").groupBy("bin").agg((F.sum("room") - F.sum(F.coalesce("size", F.lit(0)))).alias("gap"))
        sizes, open_gaps = _histogram(items, "size"), _histogram(gaps, "gap")
    if not rounds:
        return items.select("item", F.col("item").alias("bin"), F.col("size").alias("offset"))
    before = Window.partitionBy("bin").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)
    return reduce(DataFrame.unionByName, rounds).select("item", "bin", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents with the sequence each lies in and its place there."""
    pieces = written(token_pieces(docs, path, capacity, end).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity).select("*", (F.col("item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    places = best_fit(rest.select("item", F.col("length").alias("size")), capacity)
    packed = rest.join(places, "item").withColumn("sequence_id", F.col("bin") * 2)
    out = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return full.select(*out).unionByName(packed.select(*out))
