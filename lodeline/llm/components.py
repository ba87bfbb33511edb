"""Connected components by contraction, for links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch_dir, stored


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (columns a, b): the least node reachable in one component.

    In each round every node points to the least of itself and its neighbours, pointers are doubled until
    they are roots, and links are drawn between roots. Nodes are hashes, so at least a constant share of them goes each
    round. Each round's tables are written to the shared folder.
    """
    spark = links.sparkSession
    root = scratch_dir(spark)
    both = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(both, "edges-0", root)
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(parents)
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = stored(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), f"up-{k}-0", root)
        j = 0
        while True:
            far = up.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            j += 1
            up = stored(up.join(far, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), f"up-{k}-{j}", root)
            moved = not up.filter("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        parents.append(up)
        a = up.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = up.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        drawn = edges.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = stored(drawn, f"edges-{k + 1}", root)
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = parents[0].withColumnRenamed("parent", "root")
    for up in parents[1:]:
        nxt = up.select(F.col("node").alias("root"), F.col("parent").alias("_p"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("_p", "root").alias("root"))
    return out

