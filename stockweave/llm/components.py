"""Connected components of a stored or computed edge table, without collecting edges anywhere.

Union-find inside each partition turns its edges into stars. What remains between partitions is
settled by grouping: every node keeps its smallest root, its other roots are linked to that one,
and roots that have a root themselves are followed. Both steps repeat until nothing changes; the
number of rounds grows with the logarithm of the longest path.

A component may hold a third of all nodes, which all name the same root. So the roots are made
distinct (map side first) before their own roots are looked up, and what is found, at most one row
a root, is copied to SALTS places among which a root's nodes are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SALTS = 32


class UnionFind:
    """Disjoint sets of integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def union(self, a: int, b: int) -> bool:
        """True if the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = UnionFind()
    for batch in batches:
        for node, root in zip(batch["node"].tolist(), batch["root"].tolist()):
            sets.union(node, root)
    nodes = list(sets.parent)
    yield pd.DataFrame({"node": nodes, "root": [sets.find(n) for n in nodes]}, dtype="int64")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, component) for every node with an edge to another; component is the smallest node reachable.

    Edges with a null end or two equal ends say nothing; repeated edges count once. No edges: no rows.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    live = (edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
            .filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    while True:
        stars = cut(live.mapInPandas(_stars, "node long, root long").filter("node <> root"))
        least = stars.groupBy("node").agg(F.min("root").alias("least"))
        up = least.select("least").distinct().join(least.select(F.col("node").alias("least"), F.col("least").alias("above")), "least")
        up = up.select("least", "above", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        followed = least.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS).cast("long"))).join(up, ["least", "salt"], "left").select(
            "node", F.coalesce("above", "least").alias("root"), F.col("above").isNotNull().alias("moved"))
        linked = stars.join(least, "node").filter("root <> least").select(
            F.greatest("root", "least").alias("node"), F.least("root", "least").alias("root"), F.lit(True).alias("moved"))
        rows = cut(followed.unionByName(linked))
        if rows.filter("moved").isEmpty():
            return rows.select("node", F.col("root").alias("component"))
        live = rows.select("node", "root").distinct()
