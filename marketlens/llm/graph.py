"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest
    node reachable. Links may repeat or join a node with itself; nulls are no
    nodes. Every round is a grouped minimum and a join back, and is written to
    the shared folder; a node's neighbours are never collected."""
    e = edges.select("a", "b").filter("a is not null and b is not null")
    loops = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    e = stored(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = stored(loops, "nodes")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = stored(small.filter("a <> b").distinct(), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return nodes.join(e.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
