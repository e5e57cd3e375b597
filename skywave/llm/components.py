"""Connected components of a graph of pairs, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_few_files

#: Edges of 16 bytes that one task can hold; fewer are finished by one task in memory.
IN_MEMORY = 1_000_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = [b.to_numpy() for b in batches if len(b)]
    if not edges:
        return
    nodes, at = np.unique(np.concatenate(edges), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:  # hook larger roots on smaller ones, then shorten the paths
        low = np.minimum(root[a], root[b])
        if (root[a] == root[b]).all():
            break
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def components(edges: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the least node of node's component; the least
    nodes themselves may be absent.

    Each round rewires edges towards each node's least neighbour (large star: its larger neighbours;
    small star: the others), until nothing changes or in_memory edges are left, which one task
    finishes; the number of rounds grows with the logarithm of the longest path. A node with very many
    edges is pre-aggregated by min() and its edges are joined to that one number, so no list of
    neighbours is made. Only counts reach the driver. Nulls and loops are ignored; no edges give no rows.
    """
    now = in_few_files(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] <= in_memory:
            return now.coalesce(1).mapInPandas(_finish, "node long, root long")
        if mark == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = mark
        both = now.select(F.col("a").alias("n"), F.col("b").alias("m")).union(now.select("b", "a"))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        # large star: each larger neighbour hangs from the node's least neighbour (or the node itself)
        large = both.where("m > n").join(low, "n").select(F.col("low").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours hang from the least of these
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        now = in_few_files(small.where("a <> b").distinct())
