"""Periodic runs of words: Ellert and Fischer's runs over ordered alphabets.

A run is a stretch of words that repeats with a smallest period and that no neighbour extends.  Words are only
compared: they are ranked by sorting, and of the ranks, in both orders, the longest Lyndon word from every place
is computed left to right on a stack of previous smaller suffixes.  How far two suffixes agree is copied from
the pair one matched stretch earlier while that lies inside the stretch, and is read on from the stretch's end
otherwise, so that every word is compared a constant number of times.  A run's root is the longest Lyndon word
of one of the two orders, so what its edges agree on, to the right and (again reused) to the left, gives all runs.
No suffix array, no tree and no hash is made.

Before that, places that no run can hold are cut away: a run of ``times`` periods and ``least`` words repeats
each of its windows of a few words one period on, so a place lies in a run only if a window over it occurs twice
in its text.  What is left between such places is searched; a run never reaches over them.

Nothing is shuffled, collected or broadcast: a task reads texts in Arrow batches, bounded by bytes, and works
through pieces of about a million bytes, one text at least.  A text is held whole by its task, with about 30
bytes a word beside it.

Results: null and empty texts have no words, no runs and an empty collapsed text; long texts are read whole;
repeated rows each get their row; ties cannot arise, as runs are sets; an empty table gives an empty table;
columns are kept, and one named like a result stays under its name with ``_in`` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import kernels
from panelloom.llm.common import bound_batches

Run = tuple[int, int, int]
RUNS = "array<struct<start:long,length:long,period:long>>"
_LONG = 64


def lyndon_edges(s: list[int]) -> tuple[list[int], list[int]]:
    """For every place the next smaller suffix, which ends its longest Lyndon word, and how far both agree.

    The end of the text is smaller than any word.  ``held`` is the stretch last read: the words from ``there`` to
    ``end`` equal those ``shift`` places before.
    """
    n = len(s)
    after, agree = [n] * n, [0] * n
    before, common = [-1] * n, [0] * n  # previous smaller suffix, and how far it agrees
    there = end = shift = 0
    for r in range(1, n):
        at, y, last = r - 1, -1, -1
        copied = there < r < end
        while at >= 0:
            if copied:
                x = r - shift
                y = agree[at - shift] if after[at - shift] == x else common[x]
                read_on = r + y >= end
                if read_on:
                    y, copied = end - r, False
            elif y < 0:
                y, read_on = 0, True
            else:  # the previous smaller suffix of the one just passed
                x = common[last]
                read_on = x == y
                if x < y:
                    before[r], common[r] = at, x
                    break
            if read_on:
                while r + y < n and s[at + y] == s[r + y]:
                    y += 1
                there, end, shift = r, r + y, r - at
            if r + y < n and s[at + y] < s[r + y]:
                before[r], common[r] = at, y
                break
            after[at], agree[at] = r, y
            last, at = at, before[at]
    return after, agree


def find_runs(s: list[int], least: int = 6, times: int = 4) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` items and ``times`` (4 or more) periods, sorted."""
    if times < 4:
        raise ValueError("times must be at least 4")
    found: set[Run] = set()
    if len(s) < least:
        return []
    for order in (s, [-x for x in s]):
        after, agree = lyndon_edges(order)
        reach: dict[int, tuple[int, int]] = {}
        there = low = shift = 0  # the words from low to there equal those shift places on
        for i in range(len(s) - 1, -1, -1):
            p, right = after[i] - i, agree[i]
            if right <= (times - 2) * p or i >= p and after[i - p] == i and agree[i - p] >= p:
                continue  # too short, or not the first root of its run
            left = 0
            if low < i < there and p < shift:
                period, known = reach.get(i + shift, (0, 0))
                left = known if period == p and known < i - low else i - low
            if left == 0 or left == i - low:
                while left < i and s[i - 1 - left] == s[i + p - 1 - left]:
                    left += 1
                there, low, shift = i, i - left, p
            reach[i] = p, left
            length = left + p + right
            if length >= max(least, times * p):
                found.add((i - left, length, p))
    return sorted(found)


def word_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words under one total order, equal for equal words; by sorting, eight bytes at a time."""
    size = ends - starts
    ranks = np.zeros(len(starts), np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    some, at, top = np.flatnonzero(size <= _LONG), 0, 0
    while len(some):
        left = size[some] - at
        key = np.ascontiguousarray(windows[starts[some] + at]).view(">u8").ravel().astype(np.uint64)
        short = left < 8
        key[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1))
        cut = np.minimum(left, 9)
        order = np.lexsort((cut, key, ranks[some]))
        old, k, c = ranks[some][order], key[order], cut[order]
        new = np.cumsum(np.concatenate([[0], (old[1:] != old[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
        ranks[some[order]] = new + top
        top += int(new[-1]) + 1
        some, at = some[left > 8], at + 8
    whole = data.tobytes() if (size > _LONG).any() else b""
    last = None
    for word, k in sorted((whole[starts[k] : ends[k]], k) for k in np.flatnonzero(size > _LONG)):
        top += word != last
        ranks[k], last = top, word
    return ranks


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense names of pairs, by sorting."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def segments(ranks: np.ndarray, text: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of places, each within one text, outside which no run can lie."""
    width = min(max(least, times * q) - q for q in range(1, least + 1))
    n = len(ranks) - width + 1
    if n <= 0:
        return []
    names, have = _named(text, ranks), 1
    first = names
    while 2 * have <= width:  # names of longer and longer windows
        names, have = _named(names[:-have], names[have:]), 2 * have
    while have < width:
        names, have = _named(names[:-1], first[have:]), have + 1
    inside = text[:n] == text[width - 1 :]
    twice = (np.bincount(names, weights=inside) >= 2)[names] & inside
    steps = np.zeros(len(ranks) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    held = np.cumsum(steps[:-1]) > 0
    if not held.any():
        return []
    edge = np.concatenate([[True], (held[1:] != held[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], len(ranks))
    return [(int(a), int(b)) for a, b in zip(begin, stop, strict=True) if held[a] and b - a >= least]


def runs_of_texts(texts: list[bytes], least: int = 6, times: int = 4) -> list[list[Run]]:
    """The runs of each text, by place of word, sorted by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    for first, data, text_starts in kernels.joined(texts):
        black = ~kernels.IS_SPACE[data]
        edge = np.diff(black.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        counts = kernels.counts_by_text(starts, text_starts)
        text = np.repeat(np.arange(len(counts)), counts)
        base = np.cumsum(counts) - counts
        ranks = word_ranks(data, starts, ends)
        for a, b in segments(ranks, text, least, times):
            k = int(text[a])
            shift = a - int(base[k])
            out[first + k] += [(start + shift, length, p) for start, length, p in find_runs(ranks[a:b].tolist(), least, times)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def without_repeats(text: bytes, runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    words = text.split()
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Adds ``runs`` (start, length, period, by place of word) and ``collapsed``, the text without what they repeat.

    The text itself is not returned; its words come back collapsed.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    names = [f"{c}_in" if c in ("runs", "collapsed") else c for c in kept]
    source = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(kept, names, strict=True)], F.coalesce(docs[f"`{text}`"], F.lit("")).cast("binary").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            runs = runs_of_texts(texts, least, times)
            collapsed = [without_repeats(t, r).decode() for t, r in zip(texts, runs, strict=True)]
            made = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], row)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made, pa.array(collapsed, pa.string())], names=[*names, "runs", "collapsed"])

    return source.mapInArrow(batch, f"{kinds + ', ' if kinds else ''}runs {RUNS}, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The query's input: a tenth of the texts, told by the id's checksum, end in a repeated stretch of their own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def made(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    tail = F.get(F.transform(F.array(words), made), F.lit(0))  # a lambda's variable is computed once
    chosen = (h % 10 == 0) & F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return docs.withColumn("text", F.when(chosen, tail).otherwise(F.col("text")))


def runs_report(docs: DataFrame) -> DataFrame:
    """Per document: number of runs, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs.select("doc_id", "text"))
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
