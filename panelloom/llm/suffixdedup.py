"""Repeated passages by longest-previous-factor arrays over suffixes.

The question is, for every byte position, whether the ``length``-byte string that starts there also starts
earlier (for keeping first copies) or anywhere else.  In suffix order, cut at that length, equal strings
stand side by side; a position has an earlier match exactly if its longest previous factor, found at the
previous or next smaller position in suffix order, reaches ``length``.

How the suffixes are dealt out.  Each position is placed with its anchor, the k-gram with the least hash
inside its ``length`` bytes: equal strings have equal anchors at equal offsets, and the positions of one
anchor are neighbours, so a text of n bytes gives about 2n/length rows and no suffix is shuffled by itself.

1. Rows (anchor hash, hash of the whole context that the anchor's positions read) are counted.  An anchor
   seen once settles its positions as unique; one context seen several times settles them as repeated.
2. Only where an anchor stands in different contexts (the edges of copied passages) are texts compared:
   one copy of each such context is fetched, contexts with one anchor go to one task, and a suffix array
   with its previous-factor test is built over each batch of them.
3. An anchor in more contexts than ``most_contexts`` is not gathered: its strings are counted as
   fingerprints, with partial sums in every task.  This way is exact too.

Texts are shuffled twice, once to fetch contexts and once to meet the marks; both by document, so no copy
group or passage makes a hot key.  All else that moves is about a row per 190 bytes or less.

Defined cases: texts are UTF-8 bytes, null is empty; texts shorter than ``length`` hold no such string;
matches never cross documents; documents are ordered by (doc_id, text hash), nulls first, and rows equal
in both are copies of each other but cannot be told apart, so that keeping first copies keeps both; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import bound_batches, dropped, written
from panelloom.llm.kernels import _ODD, BYTE_CODE, U, joined, mix, powers

LENGTH = 400
GRAM = 32
SEGMENT = 1 << 22
MOST_CONTEXTS = 4096
BATCH = 1 << 20
ANCHORS = "doc_id long, th long, lo long, n int, o int, ahash long, chash long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h, size, k = BYTE_CODE[data], 1, 0
    while size < GRAM:
        h = h[:-size] * _ODD[k] + h[size:]
        size, k = size * 2, k + 1
    return mix(h)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash (of equal ones the first) in each window of ``width`` places."""
    key = (h & ~U((1 << 24) - 1)) | np.arange(len(h), dtype=U)
    count = len(h) - width + 1
    rows = -(-len(h) // width)
    padded = np.full(rows * width, ~U(0))
    padded[: len(h)] = key
    square = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(square, axis=1).ravel()
    return (np.minimum(ahead[:count], behind[width - 1 : width - 1 + count]) & U((1 << 24) - 1)).astype(np.int64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each byte range, equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def anchor_rows(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first start, starts, offset of the anchor, anchor hash, context hash) for groups of texts."""
    pieces, of, base = [], [], []
    for k, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), SEGMENT):
            pieces.append(t[at : at + SEGMENT + length - 1])
            of.append(k)
            base.append(at)
    of_, base_ = np.array(of, np.int64), np.array(base, np.int64)
    for first, data, piece_starts in joined(pieces):
        sizes = np.diff(np.append(piece_starts, len(data))) - 1
        place = least_places(gram_hashes(data), length - GRAM + 1)
        which = np.repeat(np.arange(len(sizes)), sizes - length + 1)
        start = np.arange(len(which)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1) + piece_starts[which]
        anchor = place[start]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])]))
        count = np.diff(np.append(new, len(which)))
        lo, own = start[new], which[new]
        h = gram_hashes(data)
        yield of_[first + own], lo - piece_starts[own] + base_[first + own], count, anchor[new] - lo, h[anchor[new]], range_hashes(data, lo, lo + count - 1 + length)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ANCHORS.split(", ")]
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for of, lo, n, o, a, c in anchor_rows(texts, length):
                ids = [batch.column(k).take(pa.array(of)) for k in ("doc_id", "th")]
                rest = [pa.array(lo), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*ids, *rest], names=names)

    return run


def dense_ranks(key: np.ndarray, bound: int) -> np.ndarray:
    """Dense ranks of keys below ``bound``, sorted together with their places in one word where both fit."""
    bits = len(key).bit_length()
    if bound << bits > 1 << 64:
        return np.unique(key, return_inverse=True)[1].astype(np.int64)
    ordered = np.sort((key << U(bits)) | np.arange(len(key), dtype=U))
    value = ordered >> U(bits)
    rank = np.empty(len(key), np.int64)
    rank[(ordered & U((1 << bits) - 1)).astype(np.int64)] = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
    return rank


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of each start in the order of suffixes cut at ``length``; equal strings have equal ranks.

    Prefixes are doubled from four bytes on, each time only at the places that the starts come to read.
    """
    steps, size = [], 4
    while size < length:
        steps.append(min(size, length - size))
        size += steps[-1]
    places = [starts]
    for by in reversed(steps):
        read = np.zeros(len(data), bool)
        read[places[-1]] = read[places[-1] + by] = True
        places.append(np.flatnonzero(read))
    at = places.pop()
    words = np.zeros(len(at), U)
    for k in range(4):
        words = (words << U(8)) | data[at + k].astype(U)
    ranks = dense_ranks(words, 1 << 32)
    everywhere = np.zeros(len(data), U)
    for by in steps:
        everywhere[at] = ranks.astype(U)
        at, many = places.pop(), int(ranks.max()) + 1
        ranks = dense_ranks(everywhere[at] * U(many) + everywhere[at + by], many * many)
    return ranks


def factor_flags(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an earlier match, has any match) per suffix, from its rank and its place in the text order.

    In suffix order with ties by position, the previous smaller position of a suffix that reaches the cut is
    the entry before it in its run of equal ranks, and its longest previous factor reaches the cut exactly if
    there is one; the mirrored array gives later matches.
    """
    order = np.lexsort((position, rank))
    equal = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    earlier[order[1:][equal]] = True
    later[order[:-1][equal]] = True
    return earlier, earlier | later


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1).tolist()


CONTEXT = "ahash long, chash long, n int, o int, f_doc long, f_th long, f_lo long, context binary"
MARKED = "ahash long, chash long, any_runs array<array<int>>, earlier_runs array<array<int>>"


def _suffix_batches(length: int):
    def solved(rows: list) -> pd.DataFrame:
        data = np.frombuffer(b"".join(r.context for r in rows), np.uint8)
        sizes = np.array([len(r.context) for r in rows])
        counts = np.array([r.n for r in rows])
        base = np.cumsum(sizes) - sizes
        begin = np.cumsum(counts) - counts
        starts = np.arange(counts.sum()) - np.repeat(begin, counts) + np.repeat(base, counts)
        in_order = np.empty(len(rows), np.int64)
        in_order[sorted(range(len(rows)), key=lambda k: (rows[k].f_doc, rows[k].f_th, rows[k].f_lo))] = np.arange(len(rows))
        position = np.repeat(in_order, counts) * np.int64(1 << 31) + (np.arange(counts.sum()) - np.repeat(begin, counts))
        earlier, either = factor_flags(suffix_ranks(data, starts, length), position)
        out = [(r.ahash, r.chash, _runs(either[b : b + c]), _runs(earlier[b : b + c])) for r, b, c in zip(rows, begin.tolist(), counts.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["ahash", "chash", "any_runs", "earlier_runs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if size > BATCH and rows[-1].ahash != r.ahash:  # contexts with one anchor stay together
                    yield solved(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r.context)
        if rows:
            yield solved(rows)

    return run


WINDOWS = "ahash long, chash long, at int, d int, h long, f_doc long, f_th long, f_lo long"


def _windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, data, base in joined(batch["context"].tolist()):
                own = {c: v.to_numpy() for c, v in batch.iloc[first : first + len(base)].drop(columns="context").items()}
                n = own["n"].astype(np.int64)
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = base[which] + at
                out = {c: own[c][which] for c in ("ahash", "chash", "f_doc", "f_th")}
                out |= {"at": at, "d": own["o"][which] - at, "h": range_hashes(data, start, start + length).view(np.int64), "f_lo": own["f_lo"][which] + at}
                yield pd.DataFrame(out)

    return run


def _repeated_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Fingerprint and first place of each string that starts more than once at its anchor."""
    each = contexts.mapInPandas(_windows(length), WINDOWS)
    return each.groupBy("ahash", "d", "h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("f_doc", "f_th", "f_lo")).alias("first")).filter("c > 1").drop("c")


def _counted_windows(contexts: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """MARKED for anchors in very many contexts: equal strings are counted, not gathered."""

    def run_lists(places: pd.Series) -> pd.Series:
        out = []
        for p in places:
            flags = np.zeros(int(max(p)) + 1 if len(p) else 0, bool)
            flags[np.asarray(p, np.int64)] = True
            out.append(_runs(flags))
        return pd.Series(out, dtype=object)

    hits = contexts.mapInPandas(_windows(length), WINDOWS).join(repeated, ["ahash", "d", "h"])
    first = F.struct("f_doc", "f_th", "f_lo") == F.col("first")
    gathered = hits.groupBy("ahash", "chash").agg(F.collect_list("at").alias("any_at"), F.collect_list(F.when(~first, F.col("at"))).alias("earlier_at"))
    as_runs = F.pandas_udf(run_lists, "array<array<int>>")
    return gathered.select("ahash", "chash", as_runs("any_at").alias("any_runs"), as_runs("earlier_at").alias("earlier_runs"))


def _sliced(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                data = r.text.encode("utf-8", "replace")
                for w in r.wanted:
                    out.append((w["ahash"], w["chash"], w["n"], w["o"], r.f_doc, r.th, w["lo"], data[w["lo"] : w["lo"] + w["n"] - 1 + length]))
            yield pd.DataFrame(out, columns=names)

    return run


def repeated_starts(docs: DataFrame, length: int = LENGTH, most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """Two tables (doc_id, th, s, e), s and e the first and last start of a run of strings.

    The first has strings that also start anywhere else, the second those that also start earlier.
    """
    anchors = written(docs.select("doc_id", "th", "text").mapInArrow(_anchors(length), ANCHORS), "anchors")
    here = F.struct("doc_id", "th", "lo")
    repeated = anchors.groupBy("ahash").agg(F.count(F.lit(1)).alias("c"), F.min("chash").alias("x"), F.max("chash").alias("y")).filter("c > 1")
    # Counts are written before they meet the rows, so that the join shuffles two plain tables and a hot anchor is split.
    repeated = written(repeated.select("ahash", (F.col("x") != F.col("y")).alias("mixed")), "repeated")
    seen = written(anchors.join(repeated, "ahash"), "seen")
    dropped(anchors)
    dropped(repeated)

    per = seen.groupBy("ahash", "chash").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "lo", "n", "o")).alias("first"), F.first("mixed").alias("mixed"))
    per = written(per, "contexts")
    wanted = per.filter("mixed").select(F.col("first.doc_id").alias("w_doc"), F.col("first.th").alias("w_th"), F.struct("ahash", "chash", "first.lo", "first.n", "first.o").alias("w"))
    wanted = wanted.groupBy("w_doc", "w_th").agg(F.collect_list("w").alias("wanted"))
    met = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th")))
    met = met.dropDuplicates(["doc_id", "th"]).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("f_doc"), "th", "text", "wanted")
    contexts = written(met.mapInPandas(_sliced(length), CONTEXT), "slices")
    sizes = contexts.groupBy("ahash").agg(F.count(F.lit(1)).alias("c"))
    # Written, so that Spark knows how small it is and broadcasts it: contexts of a crowded anchor then stay where they lie.
    many = written(sizes.filter(F.col("c") > most_contexts).select("ahash"), "crowded")
    few = contexts.join(many, "ahash", "left_anti").repartition("ahash").sortWithinPartitions("ahash")
    crowded = contexts.join(many, "ahash", "left_semi")
    windows = written(_repeated_windows(crowded, length), "windows")
    marked = few.mapInPandas(_suffix_batches(length), MARKED).union(_counted_windows(crowded, windows, length))
    marked = written(per.select("ahash", "chash", "c", "first").join(marked, ["ahash", "chash"], "left"), "marked")
    for done in (per, contexts, many, windows):
        dropped(done)
    found = seen.join(marked, ["ahash", "chash"])
    whole = F.array(F.array(F.lit(0), F.col("n") - 1))
    none = F.array().cast("array<array<int>>")
    anywhere = F.when(F.col("c") > 1, whole).otherwise(F.coalesce("any_runs", none))
    is_first = here.eqNullSafe(F.struct("first.doc_id", "first.th", "first.lo"))
    earlier = F.when(~is_first, whole).otherwise(F.coalesce("earlier_runs", none))

    def spread(runs) -> DataFrame:
        rows = found.select("doc_id", "th", "lo", F.explode(runs).alias("r"))
        return rows.select("doc_id", "th", (F.col("lo") + F.col("r")[0]).alias("s"), (F.col("lo") + F.col("r")[1]).alias("e"))

    return spread(anywhere), spread(earlier)


def _cut(length: int, with_bytes: bool):
    def run(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(text, spans, strict=True):
            data = t.encode("utf-8", "replace") if t is not None else b""
            if found is None or not len(found):
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data if with_bytes else None))
                continue
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, [x["s"] for x in found], 1)
            np.add.at(change, [x["e"] + length for x in found], -1)
            gone = np.cumsum(change)[:-1] > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return F.pandas_udf(run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").asNondeterministic()


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", with_bytes: bool = True, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_bytes``, the bytes kept.

    ``keep='first'`` removes bytes covered by strings that start earlier too; ``keep='none'`` also removes the
    first copies.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64("text").alias("th"))
    anywhere, earlier = repeated_starts(own, length, most_contexts)
    marks = {"none": anywhere, "first": earlier}[keep]
    per = marks.groupBy(F.col("doc_id").alias("m_doc"), F.col("th").alias("m_th")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    met = own.join(per, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("th") == F.col("m_th")), "left")
    out = met.select("doc_id", _cut(length, with_bytes)("text", "spans").alias("r"))
    return out.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256", *(["r.kept"] if with_bytes else []))
