"""Mixing sources to target weights.

Tokens are summed per source, the total is shared out by weight with a cap per source, and each source
gets a repetition rate.  A document is then emitted floor(rate) times, plus once more with probability
equal to the fraction, decided by a seeded hash of the document, so that reruns agree.

Texts are counted once, into a written table of small rows (of whole rows where these are emitted).  Shuffles: one
partial aggregation to a row per source, one of rows that are equal, and one join of the rows with the table of
sources (Spark broadcasts it when it is small and splits a hot source when it is not).

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source
without words gets target 0 and its documents are not taken; equal rows are numbered and draw apart, the
first as a row alone would; long texts count whole; of equal cap by weight the first source fills first; an empty table
gives an empty result; columns of the input keep their names and values whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import ROW, packed, with_occurrence, word_count, written

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most that a source gets, times its own words.
SHARE, CAP = 1.5, 2
DRAWS = 2**32


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From rows (source, size): source, source_size, weight, target, rate.

    Sources in code point order, null last, take the weights in turn.  A source whose share exceeds
    ``cap`` times its size stays at that cap and the excess goes to the others by weight: with sources in
    order of cap/weight, the level (words per unit of weight) that is left is the largest of
    (total - caps before) / (weights from here on), so no iteration is needed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.lit(cap) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "weight", "target", rate.alias("rate"))


def draw(doc_id: Column, digest: Column, occurrence: Column, seed: int) -> Column:
    """A whole number in [0, 2**32) that depends on the seed, the id, the text's digest and which of equal rows it is."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest, F.when(occurrence > 0, occurrence.cast("string")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def _planned(docs: DataFrame, seed: int, keep_rows: bool) -> DataFrame:
    row = packed(docs)
    at = F.col(ROW)
    digest = F.md5(F.coalesce(at["text"], F.lit("")))
    own = row.select(*([ROW] if keep_rows else []), at["doc_id"].alias("doc_id"), at["source"].alias("source"), word_count(at["text"]).alias("size"), digest.alias("digest"))
    equal = [F.col(ROW)] if keep_rows else [F.col("doc_id"), F.col("digest"), F.col("source")]
    own = with_occurrence(own, *equal).withColumn("draw", draw(F.col("doc_id"), F.col("digest"), F.col("occurrence"), seed))
    targets = written(source_targets(own.select("source", "size")), "targets")  # its true size is known to the join
    joined = own.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    fraction = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + (F.col("draw") < fraction * F.lit(float(DRAWS))).cast("long")
    return joined.withColumn("copies", copies)


def mix_plan(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, rate; texts do not move."""
    plan = _planned(docs, seed, keep_rows=False)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document's row as often as the plan takes it, with the input's columns."""
    plan = _planned(docs, seed, keep_rows=True).filter(F.col("copies") > 0)
    return plan.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(f"{ROW}.*")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat('17:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')), CASE WHEN k > 0 THEN concat(':', k) ELSE '' END)), 1, 8))::BIGINT AS draw
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1 AS k FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, 2 * source_size AS cap,
        (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
         - coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * (floor(rate)::BIGINT + CASE WHEN d.draw::DOUBLE < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END) AS taken,
       floor(rate)::BIGINT + CASE WHEN d.draw::DOUBLE < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END AS copies,
       rate
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
