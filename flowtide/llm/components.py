"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtide.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest node) for every node of `edges` (columns `a`, `b`, any order).

    Null ends and loops are left out; repeated edges count once; no edges give no rows. Each
    round replaces the edges by large and small stars around smallest neighbours, with sums
    before shuffles and joins against one row per node, and is written to the shared folder.
    Rounds grow with the logarithm of the longest chain. A round that changes nothing ends it.
    """
    now = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    size, digest = _state(now)
    while size:
        # every larger neighbour of a node is linked to the node's smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b")).distinct()
        # every smaller neighbour, and the node, to the smallest of them
        smallest = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
        small = large.join(smallest, F.col("b") == F.col("n")).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("n").alias("b")))).alias("e"))
        after = stored(small.select("e.a", "e.b").filter("a < b").distinct(), "edges")
        drop_stored(now)
        now, before = after, (size, digest)
        size, digest = _state(now)
        if (size, digest) == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
