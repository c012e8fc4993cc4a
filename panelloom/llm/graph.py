"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import dropped, written

#: Edges up to which a round, counted before it starts, is one task without a shuffle; about 5 MB.
SMALL = 200_000


def _each(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b) for each of ``pairs`` of columns, without a union, which would forget the partitioning."""
    made = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
    return edges.select(F.explode(made).alias("e")).select("e.a", "e.b").filter("a != b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _each(edges, ("a", "b"), ("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _each(down.join(least, "a"), ("b", "m"), ("a", "m")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b, longs); a component is named by its least node.

    Each round moves edges onto the least neighbour seen, so long chains shrink fast; rounds are written to
    the shared folder.  Only a count and a checksum per round reach the driver.  A table of at most SMALL
    edges is one partition, which needs no shuffle; a larger one is dealt out by node.
    """

    def marked(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    mark = marked(now)
    for _ in range(most_rounds):
        then = written(_small_star(_large_star(now.coalesce(1) if mark[0] <= SMALL else now)), "edges")
        seen = marked(then)
        dropped(now)
        now = then
        if seen == mark:
            least = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least)
        mark = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
