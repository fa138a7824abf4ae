"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of every vertex below the smallest of them.

    A vertex with many links is an aggregate that combines before its shuffle, and a join whose
    link side can be split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    near = both.join(least, both["a"] == least["v"])
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.where("b <= a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            near.where("b <= a").select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex hangs below one other, and that below none: then rounds change nothing any more."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("below")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("below"))
    )
    seen = ends.groupBy("v").agg(F.sum("below").alias("above"), F.min("below").alias("root"))
    return seen.where("above > 1 OR above = 1 AND root = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``links`` (a, b): the root is the component's smallest vertex.

    The number of rounds grows with the logarithm of a component's size. Every round is written to
    the shared folder. Links with a null end or equal ends are left out.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        large = stored(_star(edges, large=True))
        small = stored(_star(large, large=False))
        drop_stored(edges, large)
        edges = small
        if _settled(edges):
            break
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    )
