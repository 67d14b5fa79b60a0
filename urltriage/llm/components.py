"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours of each node on the smallest of them.

    ``large``: the greater neighbours; otherwise the smaller ones and the node.
    """
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    around = both if large else both.where("v < u")
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    joined = around.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    return (
        joined.select(F.col("v").alias("a"), F.col("least").alias("b"))
        .union(least.select("u", "least"))
        .where("a <> b")
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node of ``edges`` (a, b); root is the smallest node.

    Alternates stars of greater and of smaller neighbours until nothing changes,
    which takes few rounds also for long chains. All rounds combine before the
    shuffle; a node with very many neighbours is split by the skew join. Each round
    is written to the shared folder. Nodes without a neighbour don't appear.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        wide = stored(_stars(edges, large=True).distinct(), "large-stars")
        edges = stored(_stars(wide, large=False).distinct(), "small-stars")
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
