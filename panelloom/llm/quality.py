"""Quality rules: a decision list learned by sequential covering from labelled text statistics.

Statistics come from whole texts.  The learner takes a bounded sample of labelled rows, grows a
conjunction of thresholds by information gain, prunes it on held-back rows, and repeats on what is left.
The list it returns is a plain value; :meth:`DecisionList.expression` turns it into one ordered ``CASE``
expression that Spark evaluates like any other column.

Only the labelled sample (at most ``max_rows`` rows of numbers) reaches the driver.  Scoring has no
shuffle.

Defined cases: a null or empty text has no words, so it fails the base rule; rows without a label, and
null labels, teach nothing; without labels, or with one class only, the list is empty and keeps all that
pass the base rule; repeated rows get equal verdicts; input columns keep their names and values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import ROW, bound_batches, packed, texts_of
from panelloom.llm.kernels import IS_SPACE, counts_by_text, grams, joined, mix, words

WINDOW = 5
#: Standard deviations by which thresholds are moved to see which verdicts hold.
MARGINS = (0.0, 0.1, 0.2, 0.4)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "words_per_line")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _UPPER, _DIGITS, _MARKS = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"!?")


def _repeated_lines(text: str) -> tuple[int, int]:
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            again += line in seen
            seen.add(line)
    return again, lines


def text_counts(texts: list[str]) -> np.ndarray:
    """One row of COUNTS per text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for first, data, text_starts in joined([t.encode("utf-8", "replace") for t in texts]):
        own = slice(first, first + len(text_starts))
        starts, hashes = words(data)
        n = counts_by_text(starts, text_starts)
        out[own, 0] = n
        letters = ~IS_SPACE[data] & ((data & 0xC0) != 0x80)
        for column, flags in ((1, letters), (2, _SYMBOLS[data]), (6, _UPPER[data]), (7, _DIGITS[data]), (8, _MARKS[data])):
            out[own, column] = np.add.reduceat(flags, text_starts, dtype=np.int64)
        of = np.repeat(np.arange(len(n)), n)
        runs = grams(hashes, WINDOW)
        if len(runs):
            whole = of[: len(runs)] == of[WINDOW - 1 :]
            at = np.flatnonzero(whole)
            keys = mix(runs[at] + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(of), bool)
            for k in range(WINDOW):
                covered[at[twice] + k] = True
            out[own, 4] = np.bincount(of[covered], minlength=len(n))
    for k, t in enumerate(texts):
        out[k, 3], out[k, 5] = _repeated_lines(t)
    return out


def _counted(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(text_counts(text.fillna("").tolist()), columns=list(COUNTS))


def statistics(text: Column | str) -> Column:
    """A struct of COUNTS, worked out once per row (a deterministic function would be repeated by pushed-down filters)."""
    return F.pandas_udf(_counted, ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()(text)


def features(s: Column) -> dict[str, Column]:
    """Ratios of the counts in the struct ``s``; 0 where there are no words."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    lines = F.greatest(s["n_lines"], F.lit(1)).cast("double")
    return {
        "n_words": s["n_words"].cast("double"),
        "word_length": s["word_chars"] / n,
        "symbol_share": s["n_symbols"] / chars,
        "dup_line_share": s["n_dup_lines"] / lines,
        "repeat_share": s["n_repeat_words"] / n,
        "upper_share": s["n_upper"] / chars,
        "digit_share": s["n_digits"] / chars,
        "mark_share": s["n_marks"] / chars,
        "words_per_line": s["n_words"] / lines,
    }


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction of (feature, '<=' or '>', threshold) that rejects; others are kept."""

    rules: tuple[tuple[tuple[str, str, float], ...], ...]

    def expression(self, values: dict[str, Column]) -> Column:
        """True where the document is kept."""
        out = None
        for rule in self.rules:
            hit = F.lit(True)
            for name, way, at in rule:
                hit = hit & (values[name] <= at if way == "<=" else values[name] > at)
            out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _covers(x: np.ndarray, rule: list, inset: np.ndarray | None = None) -> np.ndarray:
    """Rows that all conditions hold for, each threshold moved inwards by its feature's ``inset``."""
    hit = np.ones(len(x), bool)
    for name, way, at in rule:
        f = FEATURES.index(name)
        by = 0.0 if inset is None else inset[f]
        hit &= x[:, f] <= at - by if way == "<=" else x[:, f] > at + by
    return hit


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained on the p rejected rows that a narrower rule still covers."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, out, -np.inf)


def _cut(v: np.ndarray, bad: np.ndarray, cuts: np.ndarray) -> tuple[float, float, str, float] | None:
    """The condition on one feature that gains most: (gain, gap, way, threshold).

    The threshold is half-way between the values that it parts, and the gap is their distance in standard deviations.
    """
    order = np.searchsorted(cuts, v, "left")
    p = np.cumsum(np.bincount(order, bad, len(cuts) + 1))
    n = np.cumsum(np.bincount(order, ~bad, len(cuts) + 1))
    best = None
    for way, gains in (("<=", _gain(p, n, p[-1], n[-1])[:-1]), (">", _gain(p[-1] - p, n[-1] - n, p[-1], n[-1])[:-1])):
        k = int(gains.argmax()) if len(gains) else -1
        if k >= 0 and gains[k] > (best[0] if best else 1e-9):
            below, above = v[v <= cuts[k]], v[v > cuts[k]]
            if len(below) and len(above):
                best = (float(gains[k]), float((above.min() - below.max()) / v.std()), way, float((below.max() + above.min()) / 2))
    return best


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], first: int | None) -> list:
    """A conjunction that covers no row to keep, or that no condition improves; ``first`` fixes its first feature."""
    rule: list = []
    inside = np.ones(len(x), bool)
    while (~bad & inside).any():
        tried = range(len(FEATURES)) if rule or first is None else (first,)
        found = [(c, f) for f in tried if (c := _cut(x[inside, f], bad[inside], cuts[f]))]
        if not found:
            break
        (_, _, way, at), f = max(found, key=lambda c: (*c[0][:2], -c[1]))
        rule.append((FEATURES[f], way, at))
        inside &= _covers(x, [rule[-1]])
    return rule


def _cover(x: np.ndarray, rejected: np.ndarray, cuts: list[np.ndarray], precision: float, support: int, seed: int, first: int | None) -> tuple:
    """One sequential covering: grow on two thirds, prune on one third, stop at a rule below ``precision`` or ``support``."""
    rules: list = []
    left = np.ones(len(x), bool)
    rng = np.random.default_rng(seed)
    while (left & rejected).sum() >= support:
        grow = left & (rng.random(len(x)) < 2 / 3)
        hold = left & ~grow
        rule = _grow(x[grow], rejected[grow], cuts, None if rules else first)

        def worth(k: int, rule=rule, hold=hold) -> float:
            hit = _covers(x[hold], rule[:k])
            p, n = (hit & rejected[hold]).sum(), (hit & ~rejected[hold]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        hit = _covers(x, rule) & left
        p, n = int((hit & rejected).sum()), int((hit & ~rejected).sum())
        held = _covers(x[hold], rule)
        if p < support or p / (p + n) < precision or held.sum() < support // 4 or rejected[hold][held].mean() < precision:
            break
        rules.append(tuple(rule))
        left &= ~hit
    return tuple(rules)


def _rejects(x: np.ndarray, rules: tuple, inset: np.ndarray | None = None) -> np.ndarray:
    return np.any([_covers(x, list(r), inset) for r in rules], axis=0) if rules else np.zeros(len(x), bool)


def _unsafe(x: np.ndarray, rejected: np.ndarray, rules: tuple) -> tuple[int, int]:
    """Wrong verdicts, and those that are wrong once thresholds move by each of MARGINS in the direction that hurts."""
    by = [m * x.std(0) for m in MARGINS]
    wrong = [int((rejected & ~_rejects(x, rules, b)).sum() + (~rejected & _rejects(x, rules, -b)).sum()) for b in by]
    return wrong[0], sum(wrong[1:])


def learn_list(x: np.ndarray, rejected: np.ndarray, precision: float = 0.95, support: int = 12, seed: int = 5) -> DecisionList:
    """The best of several sequential coverings, one greedy and one begun with each feature.

    The rule that covers most at first is not always the one to begin with: a feature that parts the classes
    almost leaves stragglers, and a cut in a crowd of rows does not hold for new ones.  Of the lists the one
    with the fewest wrong verdicts on ``x`` is taken, then the fewest near wrong ones, the shortest, the first.
    """
    if not len(x) or rejected.all() or not rejected.any():
        return DecisionList(())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 129), method="lower")) for f in range(x.shape[1])]
    lists = [_cover(x, rejected, cuts, precision, support, seed, first) for first in (None, *range(len(FEATURES)))]
    return DecisionList(min(lists, key=lambda rules: (*_unsafe(x, rejected, rules), sum(map(len, rules)))))


def measured(x: np.ndarray, rejected: np.ndarray, folds: int = 5, **options) -> dict[str, float]:
    """Verdicts on every ``folds``-th row of a list learned from the others: rows, poor ones, precision and recall."""
    held = np.arange(len(x)) % folds == 0
    hit = _rejects(x[held], learn_list(x[~held], rejected[~held], **options).rules)
    right = (hit & rejected[held]).sum()
    return {"rows": int(held.sum()), "poor": int(rejected[held].sum()), "precision": float(right / max(hit.sum(), 1)), "recall": float(right / max(rejected[held].sum(), 1))}


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and rejection of at most ``max_rows`` labelled documents, those with the smallest hash of the id.

    An id that several rows have counts once, by the text with the least hash.
    """
    own = labels.select(labels["doc_id"].alias("of"), labels["quality"].alias("quality")).filter("of is not null and quality is not null")
    own = own.groupBy("of").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("of"), "of").limit(max_rows)  # bounded, so safe to broadcast
    rows = texts_of(docs, own, "quality").select("doc_id", "quality", statistics("text").alias("s")).select("doc_id", "quality", *[c.alias(f) for f, c in features(F.col("s")).items()])
    got = rows.toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    return got[list(FEATURES)].to_numpy(float), (got["quality"] == 0).to_numpy()


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DecisionList:
    bound_batches(docs.sparkSession)
    return learn_list(*labelled_sample(docs, labels, max_rows))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Rows ``__row`` (the input), ``s`` (counts), base_failed, kept."""
    bound_batches(docs.sparkSession)
    rows = packed(docs).select(ROW, statistics(F.col(ROW)["text"]).alias("s"))
    s = F.col("s")
    failed = (s["n_words"] < 10) | (s["n_repeat_words"] * 100 > s["n_words"] * 20)
    return rows.select(ROW, "s", failed.alias("base_failed"), (~failed & rules.expression(features(s))).alias("kept"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    verdicts = judge(docs, learn_rules(docs, labels))
    return verdicts.select(F.col(ROW)["doc_id"].alias("doc_id"), *[F.col("s")[c].alias(c) for c in COUNTS[:5]], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rule and the learned list keep, with the input's columns."""
    return judge(docs, learn_rules(docs, labels)).filter("kept").select(f"{ROW}.*")
