"""Connected components by alternating large and small stars; edges never leave the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gramwise.shared import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that links reach.

    Each round hangs the larger neighbours of a node, then the smaller ones, below the smallest; rounds stop when
    the edges are stars that no longer change. A node's neighbours are never gathered: minima are aggregated and
    joined, so AQE can split a centre with many links.
    """
    now = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as links from each value to the smallest that it reaches: as many as values, at most."""
    if not len(a):
        return a, b
    own, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(own))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(own)))
    return own[far], own[label[far]]
