"""Near-duplicates by SetSketch registers.

A document is its set of distinct word shingles.  Each shingle draws points of a Poisson process, every
point falls to a random register, and a register keeps the least point, on an exponentially spaced,
truncated scale: registers of a union are the maxima of the registers, and they agree more often the more
alike two sets are.  Bands of registers propose pairs; the joint likelihood of the register comparisons
estimates the similarity of a pair, which says in what order pairs are verified on their full sets.

How it stays linear where groups are large: documents with equal sets are one node.  In a bucket only
pairs with its hub are proposed; in a few rounds every node verifies its likeliest pair that leads out of
its component.  Pairs inside a component could not change the result and are not emitted.  Buckets that
still hold several components are settled exactly: among their nodes all pairs across components that could
reach the threshold are found by prefix filtering on rare shingles and verified, whatever their estimate, so
no link between components is lost and members that only share a bucket are not paired.

With 42 bands of 6 registers a pair at similarity 0.8 shares a bucket with probability above 0.999998.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer
words than a shingle is one shingle; rows repeating an id are nodes by their texts, and the least id that
is reachable names the component; rows without an id take the least id of their component, null if there
is none; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import ROW, bound_batches, dropped, packed, written
from panelloom.llm.graph import components
from panelloom.llm.kernels import _ODD, FOLD, U, counts_by_text, grams, joined, mix, words

WIDTH = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 42
REGISTERS = ROWS * BANDS
#: Register scale: base, rate and largest value.  With these no set of 1 to 10**8 shingles is cut off.
BASE, RATE, TOP = 1.15, 20.0, 253
#: Pairs with a hub whose estimate is below the threshold by more than this, 4.5 standard errors, are left to the
#: exact join: their bucket stays open.
SLACK = 0.11


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, A to Z lower-cased."""
    out: list[np.ndarray] = []
    for _, data, text_starts in joined(texts):
        starts, hashes = words(data, fold=True)
        n = counts_by_text(starts, text_starts)
        runs, end = grams(hashes, width), np.cumsum(n)
        for k, e in zip(n.tolist(), end.tolist(), strict=True):
            if k >= width:
                out.append(np.unique(runs[e - k : e - width + 1]))
            else:
                out.append(mix(grams(hashes[e - k : e], k) + U(k)) if k else np.empty(0, U))
    return out


def true_shingles(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    w = text.translate(FOLD.tobytes()).split()
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row of uint8 per set."""
    m, count = REGISTERS, len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(count), sizes)
    state = np.concatenate([*sets, np.empty(0, U)])
    least = np.full(count * m, np.inf)
    limit = (math.log(m) + 3) / np.maximum(sizes, 1)

    def drawn(state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        state = mix(state + _ODD[0])
        gap = -np.log1p(-((state >> U(11)).astype(np.float64) * 2.0**-53)) / m
        return state, gap, ((mix(state ^ _ODD[1]) >> U(32)) * U(m) >> U(32)).astype(np.int64)

    state, at, register = drawn(state)
    while True:
        live = np.flatnonzero(at <= limit[own])
        while len(live):
            np.minimum.at(least, own[live] * m + register[live], at[live])
            state[live], gap, register[live] = drawn(state[live])
            at[live] += gap
            live = live[at[live] <= limit[own[live]]]
        short = np.isinf(least.reshape(count, m)).any(1) & (sizes > 0)
        if not short.any():
            break
        limit[short] *= 1.5
    with np.errstate(divide="ignore"):
        scaled = np.floor(1 - np.log(least / RATE) / math.log(BASE))
    return np.clip(scaled, 0, TOP).astype(np.uint8).reshape(count, m)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows, given the sizes of the sets."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    part = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def worth(j: np.ndarray) -> np.ndarray:
        p, q = part(u - v * j), part(v - u * j)
        return up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high, g = np.zeros(len(u)), np.minimum(u / v, v / u), (math.sqrt(5) - 1) / 2
    for _ in range(22):  # golden section; the likelihood has one maximum
        x, y = high - g * (high - low), low + g * (high - low)
        left = worth(x) > worth(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def _sketched(width: int):
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        values = [t.encode("utf-8", "replace") for t in text.fillna("")]
        for k in range(0, len(values), 256):
            sets = shingle_sets(values[k : k + 256], width)
            registers = sketches(sets)
            for s, r in zip(sets, registers, strict=True):
                node, other = (int((mix(s ^ o).sum(dtype=U) + U(len(s))).view(np.int64)) if len(s) else 0 for o in _ODD[:2])
                out.append((len(s), node, other, r.tobytes()))
        return pd.DataFrame(out, columns=["n", "node", "other", "sketch"])

    return F.pandas_udf(run, "n long, node long, other long, sketch binary").asNondeterministic()


def _told_apart(rows: DataFrame) -> DataFrame:
    """Sets share a node if two independent sums over their shingles agree; where only the first one does, and that is
    for a handful of nodes at most, which are broadcast, the node's number is made of both."""
    clash = rows.groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x != y").select("node", F.lit(True).alias("clash"))
    return rows.join(F.broadcast(clash), "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("clash", "other")


def _estimated(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(likely_similarity(x, y, na.to_numpy(float), nb.to_numpy(float)))


def _verified(width: int, threshold: float):
    hundredths = round(threshold * 100)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, kept = [], None, np.empty(0, U)
        for x, y in zip(a, b, strict=True):
            if x is not last:
                kept, last = shingle_sets([x.encode("utf-8", "replace")], width)[0], x
            other = shingle_sets([y.encode("utf-8", "replace")], width)[0]
            inter = len(np.intersect1d(kept, other, assume_unique=True))
            linked = 100 * inter >= hundredths * (len(kept) + len(other) - inter)
            if linked:  # by fingerprints, so look at the shingles themselves
                p, q = (true_shingles(t.encode("utf-8", "replace"), width) for t in (x, y))
                linked = 100 * len(p & q) >= hundredths * len(p | q)
            out.append(linked)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, "boolean").asNondeterministic()


def band_keys(sketch: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), F.substring(sketch, k * ROWS + 1, ROWS)) for k in range(BANDS)])


#: Hubs per node that are tried before the exact join.
HUBS = 8
#: Shingles in front of its own that a row of the prefix join carries.
BEFORE = 16


class _Pairs:
    """Estimates and verifies pairs (a, b) of nodes, which are written first, so that adaptive execution sees their size."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, width: int, threshold: float):
        self.nodes, self.texts, self.width, self.threshold = nodes, texts, width, threshold

    def likely(self, pairs: DataFrame, least: float = 0.0) -> DataFrame:
        """(a, b, estimate) of the pairs whose sizes let them reach the threshold and whose estimate is ``least`` or more."""
        pairs = written(pairs.select("a", "b"), "pairs")
        side = {s: self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s in "ab"}
        met = pairs.join(side["b"], "b").join(side["a"], "a")
        met = met.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(self.threshold * 100))
        estimate = F.pandas_udf(_estimated, "double").asNondeterministic()
        out = written(met.select("a", "b", estimate("sa", "sb", "na", "nb").alias("estimate")).filter(F.col("estimate") >= least), "likely")
        dropped(pairs)
        return out

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) by the full sets."""
        pairs = written(pairs.select("a", "b"), "pairs")
        met = pairs.join(self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        met = met.join(self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        out = written(met.select("a", "b", _verified(self.width, self.threshold)("ta", "tb").alias("linked")), "links")
        dropped(pairs)
        return out


def _shingled(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                sets = shingle_sets([t.encode("utf-8", "replace") for t in part["text"]], width)
                sizes = [len(s) for s in sets]
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), sizes), "n": np.repeat(sizes, sizes), "shingle": np.concatenate(sets).view(np.int64)})

    return run


def prefix_pairs(texts: DataFrame, components_of: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``texts`` in different components that could reach ``threshold``: exact, by prefix filtering.

    With shingles in order of rarity, alike sets share one of the first n - ceil(threshold * n) + 1, at places
    that leave enough to come.  Shingles of one text only head the order and are never joined, so members of a
    large group with own words of their own meet nobody; nor are shingles joined that one component has to itself.

    A row carries the BEFORE prefix shingles in front of its own, and two rows that share one of these do not
    meet: the row of an earlier shingle brings that pair together, at last that of the first they share.
    """
    hundredths = round(threshold * 100)
    rows = texts.select("node", "text").mapInPandas(_shingled(width), "node long, n long, shingle long")
    every = written(rows.join(components_of, "node", "left").withColumn("component", F.coalesce("component", "node")), "shingles")
    common = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), (F.min("component") != F.max("component")).alias("mixed")).filter("c > 1")
    rows = every.join(common, "shingle")
    within = Window.partitionBy("node")
    order = within.orderBy("c", "shingle")
    rows = rows.withColumn("place", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(within))
    rows = rows.filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * hundredths / 100) + 1) & F.col("mixed"))
    rows = rows.withColumn("before", F.collect_list("shingle").over(order.rowsBetween(-BEFORE, -1)))
    rows = written(rows.select("node", "n", "shingle", "place", "component", "before"), "prefixes")
    dropped(every)
    side = {s: rows.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "place", "component", "before")]) for s in "ab"}
    na, nb = F.col("a_n"), F.col("b_n")
    to_come = F.least(na - F.col("a_place"), nb - F.col("b_place")) + 1
    meet = (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * hundredths)
    meet = meet & (to_come * (100 + hundredths) >= (na + nb) * hundredths) & ~F.arrays_overlap("a_before", "b_before")
    met = side["a"].join(side["b"], "shingle").filter(meet)
    out = written(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "prefix-pairs")
    dropped(rows)
    return out


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    side = {s: found.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab"}
    met = pairs.join(side["a"], "a", "left").join(side["b"], "b", "left")
    return met.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _best(pairs: DataFrame) -> DataFrame:
    """For every node its likeliest pair."""
    both = pairs.select("a", "b", "estimate").union(pairs.select("b", "a", "estimate"))
    best = both.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(docs: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n, node, sketch), one per document, and nodes with their component, least id and first rows."""
    bound_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    rows = _told_apart(written(own.select("doc_id", F.xxhash64("text").alias("th"), _sketched(width)("text").alias("s")).select("doc_id", "th", "s.*"), "sketch"))
    nodes = rows.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("rep"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("named_rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    nodes = written(nodes, "nodes")

    bands = nodes.select("node", F.explode(band_keys(F.col("sketch"))).alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    members = written(bands.join(hubs, "key"), "members")

    in_buckets = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("rid"), F.col("rep.th").alias("rth"))
    same = F.col("doc_id").eqNullSafe(F.col("rid")) & (F.xxhash64("text") == F.col("rth"))
    texts = written(own.join(in_buckets, same).select("node", "text").dropDuplicates(["node"]), "texts")
    pairs = _Pairs(nodes, texts, width, threshold)

    # The hub is the least node of its bucket, so a < b here as in every table of pairs below.
    star = pairs.likely(members.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), threshold - SLACK)
    # A few of a node's likely hubs are enough to join most of a large group; what they miss is found below.
    few = star.groupBy("b", F.pmod(F.xxhash64("a"), F.lit(HUBS))).agg(F.max(F.struct("estimate", "a")).alias("m"))
    star = written(few.select("m.a", "b", "m.estimate"), "star")
    verified = pairs.linked(_best(star))
    for _ in range(2):
        found = components(verified.filter("linked"))
        verified = verified.union(pairs.linked(_best(_across(star, found).join(verified, ["a", "b"], "left_anti"))))

    found = written(components(verified.filter("linked")), "found")
    labelled = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    open_nodes = labelled.join(mixed, "key").select("node").distinct()
    rest = pairs.likely(prefix_pairs(texts.join(open_nodes, "node"), found, width, threshold).join(verified, ["a", "b"], "left_anti"))
    verified = verified.union(pairs.linked(_best(rest)))
    last = _across(rest, components(verified.filter("linked"))).join(verified, ["a", "b"], "left_anti")
    verified = verified.union(pairs.linked(last))

    for unread in (members, texts, star, found, rest):  # the result needs none of them
        dropped(unread)
    found = components(verified.filter("linked"))
    firsts = nodes.select("node", "first_id", F.coalesce("named_rep", "rep").alias("first_row"))
    return rows, firsts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    rows, named = _grouped(docs, width, threshold)
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_node = named.select("node", "component").join(names, "component").select(F.col("node").alias("of"), "component_id")
    out = rows.join(by_node, (F.col("n") > 0) & (F.col("node") == F.col("of")), "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, drop_unnamed: bool = False) -> DataFrame:
    """One row of each component, with the input's columns: least id, then least text hash, then one of the equal rows.

    Rows without an id stay, unless ``drop_unnamed`` counts them as members too, after all ids; rows with an
    empty set are linked with nothing and stay.  Rows are told apart by id and text hash, and a key belongs to
    one component, so the first rows of the components say for every key whether it goes.
    """
    rows, named = _grouped(docs, width, threshold)
    # A struct that begins with "has no id" puts those rows last.
    first = F.struct(F.col("first_row.doc_id").isNull().alias("x"), F.col("first_row.doc_id").alias("id"), F.col("first_row.th").alias("th"))
    firsts = named.groupBy("component").agg(F.min(first).alias("m")).select(F.col("m.id").alias("first_id"), F.col("m.th").alias("first_th"))
    members = rows.filter("n > 0") if drop_unnamed else rows.filter("n > 0 AND doc_id IS NOT NULL")
    keys = members.groupBy(F.col("doc_id").alias("key_id"), F.col("th").alias("key_th")).agg(F.count(F.lit(1)).alias("c"))
    is_first = F.col("key_id").eqNullSafe(F.col("first_id")) & (F.col("key_th") == F.col("first_th"))
    gone = keys.join(firsts, is_first, "left_anti").select("key_id", "key_th")
    repeated = written(keys.filter("c > 1").join(firsts, is_first, "left_semi").select("key_id", "key_th"), "repeated")

    rows = packed(docs).withColumn("th", F.xxhash64(F.col(ROW)["text"]))
    is_key = F.col(ROW)["doc_id"].eqNullSafe(F.col("key_id")) & (F.col("th") == F.col("key_th"))
    rows = rows.join(gone, is_key, "left_anti")
    if repeated.isEmpty():
        return rows.select(f"{ROW}.*")
    # Partial aggregates leave one row per key and task, however often it is repeated.
    once = rows.join(repeated, is_key).groupBy("key_id", "key_th").agg(F.first(ROW).alias(ROW))
    return rows.join(repeated, is_key, "left_anti").select(f"{ROW}.*").union(once.select(f"{ROW}.*"))
