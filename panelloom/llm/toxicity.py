"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every n-gram of 3 to 5 characters of the lower-cased text is hashed to a bucket; a document is the set of
its buckets, and of marks for those that it repeats often for its length.  Document counts per bucket and
class give the log-count ratios, logistic regression is fitted on the ratios of the most telling buckets
present, and the product of weight and ratio is one number per bucket.
Scoring sums these numbers over a text's buckets, in tasks, without a shuffle; the model is an array of a
fixed size, whatever the corpus.

The fit reads a bounded sample of labelled rows (``max_rows``); the held-out rows, crc32 of the id modulo
5 equal to 0, are never read for it.  Scores depend on the text alone.

Defined cases: null and empty texts score as a text without n-grams; null labels teach nothing; of
several labels for an id the largest counts; without both classes every score is the share of label 1 (0
without labels); repeated rows score alike; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import bound_batches, texts_of
from panelloom.llm.kernels import U

BUCKETS = 1 << 20
ORDERS = (3, 4, 5)
MAX_ROWS = 10_000
#: Buckets with a part in the fit: those in LEAST sampled documents or more, and of these the MAX_FEATURES with the
#: largest ratios, weighted by how many documents have them.  With all of them the fit does not converge (README).
LEAST, MAX_FEATURES = 4, 20_000
#: Occurrences per 1000 characters from which a bucket is marked as frequent, and the L2 penalty of the fit.
FREQUENT, REGULAR = 1.5, 1e-2


def buckets(text: str) -> np.ndarray:
    """Distinct features of a text: its buckets, and BUCKETS more for each that is FREQUENT and seen twice or more."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    h, found = chars.copy(), []
    for n in range(2, max(ORDERS) + 1):
        if len(chars) < n:
            break
        h = h[: len(chars) - n + 1] * U(0x100000001B3) + chars[n - 1 :]
        if n in ORDERS:
            found.append((((h + U(n)) * U(0x9E3779B97F4A7C15)) >> U(64 - 20)).astype(np.int32))
    if not found:
        return np.empty(0, np.int32)
    at = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    counts = np.diff(np.append(first, len(at)))
    often = first[(counts >= 2) & (counts * 1000 >= FREQUENT * len(chars))]
    return np.concatenate([at[first], at[often] + np.int32(BUCKETS)])


def _bucket_sets(text: pd.Series) -> pd.Series:
    return pd.Series([buckets(t) for t in text.fillna("")], dtype=object)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Model:
    """Weight times ratio per bucket, and the intercept."""

    def __init__(self, values: np.ndarray, intercept: float):
        self.values, self.intercept = values, intercept

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.values[buckets(t)].sum(dtype=np.float64) for t in texts]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Rows (y, buckets) of at most ``max_rows`` labelled documents outside the held-out fold, by hash of the id; an id counts once."""
    own = labels.select(labels["doc_id"].alias("of"), labels["toxic"].alias("y")).filter("of is not null and y is not null")
    own = own.filter(~held_out(F.col("of"))).groupBy("of").agg(F.max("y").cast("double").alias("y"))
    own = own.orderBy(F.xxhash64("of"), "of").limit(max_rows)  # bounded, so safe to broadcast
    rows = texts_of(docs, own, "y")
    return rows.select("y", F.pandas_udf(_bucket_sets, "array<int>")("text").alias("buckets"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, smooth: float = 1.0, least: int = LEAST, most: int = MAX_FEATURES) -> Model:
    bound_batches(docs.sparkSession)
    sample = training_sample(docs, labels, max_rows).persist()
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    values = np.zeros(2 * BUCKETS, np.float32)
    if not 0 < positive < n:
        share = positive / n if n else 0.0
        sample.unpersist()
        return Model(values, 60.0 if share else -60.0)
    per = sample.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("all"))
    smoothed = [(F.col("pos") + smooth) / (positive + smooth), (F.col("all") - F.col("pos") + smooth) / (n - positive + smooth)]
    ratio = F.log(smoothed[0] / smoothed[1])
    top = per.filter(F.col("all") >= least).select("bucket", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt("all")).alias("worth"))
    top = top.orderBy(F.desc("worth"), "bucket").limit(most).toPandas()  # bounded by ``most``
    place = np.full(2 * BUCKETS, -1, np.int32)
    place[top["bucket"]] = np.arange(len(top))
    shared = docs.sparkSession.sparkContext.broadcast((place, top["ratio"].to_numpy()))

    @F.udf(VectorUDT())
    def scaled(found):
        place, ratios = shared.value
        at = np.sort(place[np.array(found, np.int64)]) if found else np.empty(0, np.int32)
        at = at[at >= 0]
        return Vectors.sparse(len(ratios), at.tolist(), ratios[at].tolist())

    # The rarer class weighs more, by the root of the imbalance: half-way to equal classes.
    rarer = ((n - positive) / positive) ** 0.5
    rows = sample.select(F.col("y").alias("label"), F.when(F.col("y") > 0, rarer).otherwise(1.0).alias("weight"), scaled("buckets").alias("features"))
    model = LogisticRegression(maxIter=60, regParam=REGULAR, standardization=False, weightCol="weight").fit(rows)
    values[top["bucket"]] = model.coefficients.toArray() * top["ratio"].to_numpy()
    sample.unpersist()
    return Model(values, float(model.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(text.fillna("").tolist()))

    out = docs.select(docs["doc_id"].alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), scored(docs["text"]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
