"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep

#: Links of one node that stay under one key, at least, and nodes that may have more, about.
HUB, HUBS = 256, 100_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to one link (node, smallest node of its component) for each node that isn't the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (u, v):
            np.minimum.at(new, x, low)
            np.minimum.at(new, label[x], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links`` (long columns u and v) but the roots; root is its component's smallest node.

    Each round is a large-star and a small-star step over the links; every round's links are written out, so that a
    lost executor costs no more than its own tasks. Where no node has more than the links of a hub, a step is a window
    over each node's links: three exchanges a round. A node with more, the hub of a star, has its minimum pre-aggregated,
    and the join of that back to its links is salted. The rounds end when every link leads to a node that leads nowhere,
    and grow with the logarithm of the size.
    """
    tidy = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = keep(tidy, "links")
    while True:
        ends = edges.select("u", F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        open_ = (F.col("up") > 0) & (F.col("n") > 1)
        count, most, left = nodes.agg(F.sum("up"), F.max("n"), F.max(open_)).first()
        if not left:
            return edges.select("u", F.col("v").alias("root"))
        hub = max(HUB, count // HUBS)
        star = partial(_with_least, hub=hub) if most > hub else _with_least_of_few
        both = edges.union(edges.select("v", "u"))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        small = star(large.distinct() if most > hub else large).select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        edges = keep(small.distinct(), "links")


def _with_least_of_few(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with the least v of each u, none of which has many. In a small-star step a node has as many links
    as before the round at most: one from each neighbour."""
    return links.withColumn("low", F.min("v").over(Window.partitionBy("u")))


def _with_least(links: DataFrame, hub: int) -> DataFrame:
    """``links`` (u, v) with the least v of each u; the links of a u that has more than ``hub`` are dealt over several keys."""
    of = links.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", "low", F.ceil(F.col("n") / hub).cast("int").alias("salts"))
    hubs = of.where("salts > 1").select("u", "salts")  # 4 HUBS at most, since all links together are no more
    salted = links.join(F.broadcast(hubs), "u", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    least = of.select("u", "low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return salted.join(least, ["u", "salt"])
