"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge, itself included.

    Each step joins the edges with the least neighbour of one end, an aggregate that is combined before the shuffle, so a
    node with very many edges costs one row per map task; the join's rows can be split where a node is hot.  Steps repeat
    until the edges stop changing, each step's edges being written to the shared folder.  Null ends and loops are dropped;
    an empty table gives an empty one.
    """
    now = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.hash("lo", "hi").cast("long"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        nxt = written(_small_star(_large_star(now)), "edges")
        discard(now)
        now = nxt
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.union(roots)


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour or itself."""
    both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(
        # a node larger than all its neighbours stays linked to the least of them
        least.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))
    ).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the least of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()
