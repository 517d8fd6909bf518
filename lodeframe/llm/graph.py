"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import discard, stored


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Rows ``(node, component)`` for every node on an edge; component is the smallest node reached.

    Every round points each node at its smallest neighbour (or itself), follows
    pointers until they stop, and relabels the edges with the roots.  Loops and
    repeated edges drop out, so at least half of the remaining nodes vanish per
    round.  Only tables of edges and labels exist; nothing is gathered on the
    driver but a row count.  Null ends and loops are ignored; no edges give an
    empty table.
    """
    pair = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    pair = pair.where("a is not null and b is not null and a <> b")
    pair = stored(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = base = None
    while not pair.isEmpty():
        both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        table = stored(parent.select("node", F.least("node", "up").alias("up")))
        while True:
            # pointer doubling: up <- up(up)
            parent = table.select("node", "up")
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")))
            discard(table, shuffles=False)
            table = jumped
            if table.where("moved").isEmpty():
                break
        root = table.select("node", "up")
        left = root.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = root.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        rest = pair.join(left, "a").join(right, "b").where("ra <> rb")
        rest = stored(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(pair, shuffles=False)
        pair = rest
        if labels is None:
            labels, base = root.select("node", F.col("up").alias("component")), table
            continue
        step = root.select(F.col("node").alias("component"), "up")
        labels = stored(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        discard(base, table, shuffles=False)
        base = labels
    if labels is None:
        return pair.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(pair, shuffles=False)
    return labels
