"""Connected components of an edge table, by contraction.

Each round hooks every node to its smallest neighbour, follows these pointers to their roots by doubling, and
contracts the edges to edges between roots. Nothing is collected; a round works on tables of distinct rows
that shrink, each written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut


def roots(parent: DataFrame) -> DataFrame:
    """(v, p) with p a root. `parent`: (v, p), p < v for all but roots, which may be missing."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = cut(parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        parent = step.select("v", "p")
        if not step.where("moved").limit(1).count():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each node of `edges` (a, b): root is the smallest node that v reaches."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = None
    while edges.limit(1).count():
        hook = roots(cut(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))))
        if out is None:
            out = hook
        else:
            seen = out.select("v", F.col("p").alias("q"))
            moved = seen.join(hook.select(F.col("v").alias("q"), "p"), "q", "left").select("v", F.coalesce("p", "q").alias("p"))
            out = cut(moved.unionByName(hook.join(out.select("v"), "v", "left_anti")))
        end = lambda side: hook.select(F.col("v").alias(side), F.col("p").alias(f"{side}_root"))
        edges = edges.join(end("a"), "a", "left").withColumn("a", F.coalesce("a_root", "a")).drop("a_root")
        edges = edges.join(end("b"), "b", "left").withColumn("b", F.coalesce("b_root", "b")).drop("b_root")
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if out is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    top = out.select(F.col("p").alias("v")).distinct().withColumn("p", F.col("v")).join(out.select("v"), "v", "left_anti")
    return out.unionByName(top).withColumnRenamed("p", "root")
