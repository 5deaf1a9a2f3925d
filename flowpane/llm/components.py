"""Connected components of a link table by contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpane.llm.common import stage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the smallest node of its component.

    In a round, every node points to its least neighbour (or itself), the pointers are followed three times further, and links
    are drawn anew between what the pointers reach; the nodes left with links are at most about half as many. Only links and
    one row per node move, and minima are taken before the shuffle; no component is ever gathered in one place.
    """
    left = stage(links.select("a", "b"), "links")
    roots = None
    for _ in range(max_rounds):
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to")), "pointers")
        for _ in range(2):
            to = stage(to.join(to.select(F.col("node").alias("to"), F.col("to").alias("further")), "to")
                       .select("node", F.col("further").alias("to")), "pointers")
        a, b = (to.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        drawn = left.join(a, "a").join(b, "b").filter("a_to <> b_to")
        left = stage(drawn.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        if roots is None:
            roots = to.withColumnRenamed("to", "root")
        else:
            roots = stage(roots.join(to.withColumnRenamed("node", "root"), "root", "left")
                          .select("node", F.coalesce("to", "root").alias("root")), "roots")
        if left.isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
