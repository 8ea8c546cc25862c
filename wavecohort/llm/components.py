"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm.stored import kept, scratch, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``edges`` (two long columns).

    Alternates the star steps of Kiveris et al. (2014): every node hangs its
    larger neighbours, then all but the smallest of the smaller ones, on the
    smallest neighbour.  The edge table never grows, the number of rounds is
    logarithmic, and every round is written, so a lost executor costs a read.
    Self loops and null ends are ignored; an empty table gives no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    with scratch(edges.sparkSession):
        pairs = stored(pairs, "edges")
        before = None
        while True:
            pairs = stored(_star(_star(pairs, True), False), "star")
            now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
            if now == before:
                break
            before = now
        roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return kept(roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v) after one star step.

    A node's neighbours are never gathered: its smallest one comes from a
    map-side aggregate and joins back.
    """
    both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    moved = both.join(least, "x")
    if large:
        out = moved.filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("y").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
