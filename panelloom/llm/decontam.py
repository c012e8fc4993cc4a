"""Benchmark decontamination by greedy string tiling.

Token runs that a document shares with a benchmark item seed the search (a join on run fingerprints); for
pairs whose seeds could cover enough of the item, the longest non-overlapping common runs are marked
again and again, found by Karp-Rabin fingerprints and confirmed token by token (64-bit fingerprints of
single tokens), until no run of ``min_tile`` tokens is left.  A pair counts as a leak when its tiles cover ``coverage`` of the item's
tokens, in any order, so passages with moved sentences are caught too.

The seed index of the benchmark is broadcast only while its token count, checked first, is within
``broadcast_tokens``; beyond that the seeds are joined by shuffle.  Both ways give the same rows.  The
documents' texts are read once and, with the broadcast index, never shuffled.

Defined cases: tokens are runs of letters and digits, lower-cased; null and empty texts, and items with
fewer tokens than ``min_tile``, match nothing; repeated rows give repeated answers; an empty benchmark or
corpus gives no leaks; input columns keep their names and values.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import ROW, bound_batches, packed
from panelloom.llm.kernels import U, counts_by_text, grams, joined, words

MIN_TILE = 5
COVERAGE = 0.8
BROADCAST_TOKENS = 2_000_000
HIT = "item_id long, n_tokens int, n_covered int, n_tiles int, tiles string"

_GAPS = re.compile(r"[\W_]+")
_ASCII = {k: " " for k in range(128) if not chr(k).isalnum()}


def folded(text: str) -> bytes:
    """Lower-cased tokens with single spaces between them."""
    low = text.lower()
    low = low.translate(_ASCII) if low.isascii() else _GAPS.sub(" ", low)
    return low.encode("utf-8", "replace")


def fingerprints(text: str) -> np.ndarray:
    data = folded(text) + b"\n"
    return words(np.frombuffer(data, np.uint8))[1]


def common_runs(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Maximal runs (length, item start, doc start) of equal tokens, at least ``min_tile`` long.

    Only places of ``doc`` under a shared seed are looked at.  The item is read from its end: how long each of those
    places agrees with the item from token i on is one more than the next place does from token i + 1 on.  So a
    text of one repeated word costs time by the product of the lengths, and memory by the document's alone.
    """
    near = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(np.isin(grams(doc, min_tile), grams(item, min_tile)))
    np.add.at(near, at, 1)
    np.add.at(near, at + min_tile, -1)
    place = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    if not len(place):
        return []
    tokens, joins = doc[place], np.append(np.diff(place) == 1, False)  # whether the next one looked at is the next in the text
    runs, agree, equal = [], np.zeros(len(place) + 1, np.int32), tokens == item[-1]
    for i in range(len(item) - 1, -1, -1):
        agree[:-1] = np.where(equal, np.where(joins, agree[1:], 0) + 1, 0)
        before = tokens == item[i - 1] if i else np.zeros(len(place), bool)
        goes_on = np.append(False, (before & joins)[:-1])
        starts = np.flatnonzero((agree[:-1] >= min_tile) & ~goes_on)
        runs += zip(agree[starts].tolist(), [i] * len(starts), place[starts].tolist(), strict=True)
        equal = before
    return runs


def tile(item: np.ndarray, doc: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length), longest first, no token in two tiles."""
    heap = [(-n, i, j) for n, i, j in common_runs(item, doc, min_tile)]
    heapq.heapify(heap)
    used_item, used_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~(used_item[i : i + n] | used_doc[j : j + n])
        if free.all():
            used_item[i : i + n] = used_doc[j : j + n] = True
            tiles.append((i, j, n))
            continue
        edge = np.diff(free.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a >= min_tile:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


class Index:
    """Seeds of the benchmark: sorted run fingerprints with the item and place of each."""

    def __init__(self, items: list[tuple[int, str]], min_tile: int, coverage: float):
        self.min_tile, self.coverage = min_tile, coverage
        self.ids = [i for i, _ in items]
        self.tokens = [fingerprints(t) for _, t in items]
        own = [grams(t, min_tile) for t in self.tokens]
        seeds = np.concatenate([*own, np.empty(0, U)])
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.item = np.repeat(np.arange(len(own)), [len(g) for g in own])[order]
        self.place = np.concatenate([*[np.arange(len(g)) for g in own], np.empty(0, np.int64)])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.seeds & U((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, runs: np.ndarray) -> list[int]:
        """Items of which the shared seeds cover enough; tiles never cover more than the seeds do."""
        runs = np.unique(runs)
        low, high = np.searchsorted(self.seeds, runs, "left"), np.searchsorted(self.seeds, runs, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a] or [np.empty(0, np.int64)]).astype(np.int64)
        out = []
        for k in np.unique(self.item[at]).tolist():
            covered = np.zeros(len(self.tokens[k]), bool)
            places = self.place[at[self.item[at] == k]]
            for step in range(self.min_tile):
                covered[places + step] = True
            if covered.sum() >= self.coverage * len(covered):
                out.append(k)
        return out

    def hits(self, texts: list[str]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.seeds):
            return out
        for first, data, text_starts in joined([folded(t) for t in texts]):
            starts, hashes = words(data)
            n = counts_by_text(starts, text_starts)
            ends = np.cumsum(n)
            runs = grams(hashes, self.min_tile)
            shared = np.flatnonzero(self.seen[(runs & U((1 << 20) - 1)).astype(np.int64)])
            shared = shared[np.isin(runs[shared], self.seeds)]
            text_of = np.searchsorted(ends, shared, "right")
            inside = shared + self.min_tile <= ends[text_of] if len(shared) else np.empty(0, bool)
            shared, text_of = shared[inside], text_of[inside]
            for k in np.unique(text_of).tolist():
                own = hashes[ends[k] - n[k] : ends[k]]
                found = [self.leak(c, own) for c in self.candidates(runs[shared[text_of == k]])]
                out[first + k] = [f for f in found if f]
        return out

    def leak(self, k: int, doc: np.ndarray) -> dict | None:
        return measured(self.ids[k], self.tokens[k], doc, self.min_tile, self.coverage)


def measured(item_id: int, item: np.ndarray, doc: np.ndarray, min_tile: int, coverage: float) -> dict | None:
    tiles = tile(item, doc, min_tile)
    covered = sum(n for _, _, n in tiles)
    if not len(item) or covered < coverage * len(item):
        return None
    text = ",".join(f"{i}:{j}:{n}" for i, j, n in sorted(tiles))
    return {"item_id": item_id, "n_tokens": len(item), "n_covered": covered, "n_tiles": len(tiles), "tiles": text}


def _tokens_in(bench: DataFrame) -> int:
    """An upper bound of the benchmark's tokens: half its characters, rounded up per item."""
    return bench.agg(F.sum(F.ceil(F.char_length("text") / 2))).first()[0] or 0


def with_hits(docs: DataFrame, bench: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """Rows ``__row`` (the input) and ``hits``, an array with an entry per leaked benchmark item."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = bench.select(bench["item_id"].alias("item_id"), bench["text"].alias("text")).filter("text is not null")
    rows = packed(docs)
    if _tokens_in(items) > broadcast_tokens:
        return _joined_hits(rows, items, min_tile, coverage)
    own = sorted(((r.item_id, r.text) for r in items.collect()), key=lambda x: (x[0] is None, x))  # within broadcast_tokens
    index = spark.sparkContext.broadcast(Index(own, min_tile, coverage))

    @F.pandas_udf(f"array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    def hits(text: pd.Series) -> pd.Series:
        return pd.Series(index.value.hits(text.fillna("").tolist()), dtype=object)

    # Declared non-deterministic, or the filter that explode implies would work it out a second time.
    return rows.select(ROW, hits.asNondeterministic()(F.col(ROW)["text"]).alias("hits"))


def _joined_hits(rows: DataFrame, items: DataFrame, min_tile: int, coverage: float) -> DataFrame:
    """The same by a shuffled join of seeds, for benchmarks beyond the broadcast bound."""
    from panelloom.llm.common import written

    @F.pandas_udf("array<long>")
    def seeds(text: pd.Series) -> pd.Series:
        return pd.Series([grams(fingerprints(t), min_tile).view(np.int64).tolist() for t in text.fillna("")], dtype=object)

    @F.pandas_udf(f"struct<{HIT.replace(' ', ':').replace(',:', ',')}>")
    def tiled(item_id: pd.Series, item: pd.Series, doc: pd.Series) -> pd.DataFrame:
        found = [measured(i, fingerprints(a), fingerprints(b), min_tile, coverage) for i, a, b in zip(item_id, item, doc, strict=True)]
        none = dict.fromkeys(("item_id", "n_tokens", "n_covered", "n_tiles", "tiles"))
        return pd.DataFrame([f or none for f in found], columns=list(none)).astype({k: "Int64" for k in list(none)[:4]})

    rows = written(rows.withColumn("__id", F.monotonically_increasing_id()), "decontam-rows")
    items = items.withColumn("of", F.monotonically_increasing_id())
    items = written(items, "decontam-items")
    n = items.select("of", "item_id", F.col("text").alias("item"), F.posexplode(seeds("text")).alias("place", "seed"))
    sizes = n.groupBy("of").agg((F.max("place") + min_tile).alias("n"))
    doc_seeds = rows.select("__id", F.explode(F.array_distinct(seeds(F.col(ROW)["text"]))).alias("seed"))
    shared = doc_seeds.join(n.select("of", "place", "seed"), "seed").groupBy("__id", "of").agg(F.collect_set("place").alias("places"))
    spread = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (min_tile - 1))))))
    likely = shared.join(sizes, "of").filter(spread >= F.lit(coverage) * F.col("n")).select("__id", "of")
    found = likely.join(rows, "__id").join(items, "of").select("__id", tiled("item_id", "text", F.col(ROW)["text"]).alias("hit"))
    found = found.filter("hit.n_tokens is not null").groupBy("__id").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    return rows.join(found, "__id", "left").select(ROW, F.coalesce("hits", F.array()).alias("hits"))


def leaks(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """One row per document and benchmark item that it leaks."""
    rows = with_hits(docs, bench, **options).select(F.col(ROW)["doc_id"].alias("doc_id"), F.explode("hits").alias("hit"))
    return rows.select("doc_id", "hit.*").withColumn("coverage", F.col("n_covered") / F.col("n_tokens"))


def without_leaks(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that leak no item, with the input's columns."""
    return with_hits(docs, bench, **options).filter(F.size("hits") == 0).select(f"{ROW}.*")
