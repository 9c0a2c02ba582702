"""Connected components of a graph given as a table of edges, by hooking on minima and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.llm.common import discard, stored, stored_small


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges (a, b)``; the root is the least node that it can reach.

    In a round every node hooks onto its least neighbour (or itself), then onto that one's choice; edges are rewritten
    to the chosen nodes and those inside one vanish. Each round is written to the shared folder, and all of its
    aggregations combine map-side, so a node with very many edges is no hot spot.
    """
    left = stored(_ordered(edges, "a", "b"), "edges")
    roots: DataFrame | None = None
    while n := left.count():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored_small(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hooks", 2 * n)
        over = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        hooked = stored_small(up.join(over, "up", "left").select("node", F.coalesce("up2", "up").alias("root")), "hooked", 2 * n)
        a, b = hooked.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooked.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        fewer = stored_small(_ordered(left.join(a, "a").join(b, "b"), "ra", "rb"), "edges", n)
        discard(up, left)
        left = fewer
        if roots is None:
            roots, n_roots = hooked, hooked.count()
            continue
        to = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = stored_small(roots.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots", n_roots)
        discard(roots, hooked)
        roots = moved
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return roots


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
