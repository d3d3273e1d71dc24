"""Connected components of links between long ids, as DataFrames: rounds of hooking, shortcutting and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, together


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of its component, for every id that has a link. ``links`` has columns a and b.

    In each round every node hooks to its smallest neighbour (or stays), takes that one's hook as well, and links
    between different roots are carried to the next round. A star of any size is done after two rounds. Loops and
    repeated links are allowed; null ends are left out.
    """
    edges = cut(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while n := edges.count():
        edges = together(edges, n)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        above = hook.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        jump = cut(hook.join(above, "p").select("id", F.least("p", "pp").alias("to")))
        left = edges.join(jump.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if roots is None:
            roots = jump.select("id", F.col("to").alias("root"))
        else:
            roots = cut(roots.join(jump.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
    release(links.sparkSession)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")) if roots is None else roots
