"""Connected sets of a link table: local contraction and alternating large and small stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vectext.session import cut_lineage

MAX_STEPS = 100
#: Links that one task contracts at a time.
SHARE_LINKS = 200_000


def join_roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the pairs into ``root``, in place; returns the pairs that joined two trees."""
    used = np.zeros(len(left), dtype=bool)
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[max(i, j)] = min(i, j)
            used[k] = True
    while True:
        shorter = root[root]
        if (shorter == root).all():
            break
        root[:] = shorter
    return left[used], right[used]


def stars(links: pd.DataFrame) -> pd.DataFrame:
    """The sets of some links as stars around their least nodes."""
    nodes, ends = np.unique(np.concatenate([links["u"], links["v"]]), return_inverse=True)
    root = np.arange(len(nodes))
    join_roots(root, ends[:len(links)], ends[len(links):])
    outer = root != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[root[outer]], "v": nodes[outer]})


def contract(edges: DataFrame, links: int) -> DataFrame:
    """Stars of the links that lie in one task, in shares of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= SHARE_LINKS:
                yield stars(pd.concat(held))
                held = []
        if held:
            yield stars(pd.concat(held))

    return edges.coalesce(max(1, math.ceil(links / SHARE_LINKS))).mapInPandas(run, "u bigint, v bigint")


def large_star(edges: DataFrame) -> DataFrame:
    """Every node passes its larger neighbours on to the least node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("m").alias("u"), "v")


def small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``u < v``; the root is the set's least node.

    Links that lie together are contracted in their tasks, star steps join what
    lies apart, until nothing moves. Each step is written, so a lost executor
    costs one step at most. The number of steps grows with the logarithm of the
    longest chain.
    """
    edges, state = cut_lineage(edges), None
    # Contracted before the loop: a share's links that stay as they are say nothing about links in other shares.
    edges = cut_lineage(contract(edges, edges.count()))
    for _ in range(MAX_STEPS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = cut_lineage(contract(small_star(large_star(edges)), now[0]))
    else:
        raise RuntimeError("the links did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("root")))
