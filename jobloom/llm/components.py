"""Connected components of a table of links, by union-find in tasks of bounded size.

The links are dealt evenly over as many tasks as LINKS_PER_TASK asks for; each task
joins its links and names, for every node, the root of the node's tree there. A
node that several tasks saw hangs on the least of its roots, and its other roots
are linked to that one: these are the links of the next level, over roots alone.
Roots are the least by a hash that changes with the level, so a node that isn't the least among its
neighbours is gone after a level, and levels are as many as the logarithm of
the links that don't fit one task. On the way back every node takes the
component of the root it hangs on.

Neither dealing nor grouping gathers a hot node: links are dealt by both ends, and a
node has one root from each task at most. What a level hands on is written to the shared folder,
so lineage stays short; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links that one task joins (16 MB, some 200 MB while it runs).
LINKS_PER_TASK = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of a partition: each node with the root of its tree, the end least by (order, node)."""
    parent: dict[int, int] = {}
    order: dict[int, int] = {}
    for b in batches:
        order.update(zip(b["a"].tolist(), b["oa"].tolist(), strict=True))
        order.update(zip(b["b"].tolist(), b["ob"].tolist(), strict=True))
        for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
            roots = []
            for n in (x, y):
                top = n
                while parent.setdefault(top, top) != top:
                    top = parent[top]
                while parent[n] != top:
                    parent[n], n = top, parent[n]
                roots.append((order[top], top))
            parent[max(roots)[1]] = min(roots)[1]
    found = []
    for n in parent:
        top = n
        while parent[top] != top:
            top = parent[top]
        found.append(top)
    yield pd.DataFrame({"node": list(parent), "root": found}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) -> node, component (smallest node reachable), for every node of a link."""
    edges = materialize(links.where("a <> b").select("a", "b"), "links")
    hung: list[DataFrame] = []
    while True:
        tasks = max(1, -(-edges.count() // LINKS_PER_TASK))
        level = len(hung)
        dealt = edges.repartition(tasks, "a", "b") if tasks > 1 else edges.coalesce(1)
        order = lambda c: (F.col(c) if tasks == 1 else F.xxhash64(F.col(c), F.lit(level))).alias("o" + c)  # noqa: E731, B023
        roots = dealt.select("a", "b", order("a"), order("b")).mapInPandas(_forest, "node long, root long")
        if tasks == 1:
            found = materialize(roots.select("node", F.col("root").alias("component")), "components")
            break
        roots = materialize(roots, "roots")
        least = roots.groupBy("node").agg(F.min(F.struct(F.xxhash64("root", F.lit(level)), "root"))["root"].alias("on"))
        least = materialize(least, "hung")
        hung.append(least)
        edges = roots.join(least, "node").where("root <> on").select(F.col("root").alias("a"), F.col("on").alias("b")).distinct()
        edges = materialize(edges, "links")
    if not hung:
        return found
    for least in reversed(hung):
        up = found.select(F.col("node").alias("top"), "component")
        found = materialize(least.join(up, F.col("on") == F.col("top"), "left").select("node", F.coalesce("component", "on").alias("component")), "found")
    names = found.groupBy("component").agg(F.min("node").alias("least"))
    return materialize(found.join(names, "component").select("node", F.col("least").alias("component")), "components")
