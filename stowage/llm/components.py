"""Connected components of links held in a DataFrame: alternating large-star and small-star rounds, never on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, sized


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as stars: every node but the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def stars(links: DataFrame, rounds: int = 60, per: int = 1 << 18, known: int | None = None) -> Kept:
    """links(a, b): not null and of one ordered type. Gives (a, b): each node but the smallest of its component, and that node.

    Each round is written to the shared folder, in files of about `per` links, so a lost executor costs one round at most. No
    node's neighbours are ever gathered in a list: a round is minima by node and joins that Spark may split where a node is hot.
    known: how many links there are, where that is known.
    """
    start = links.select("a", "b").where("a <> b").distinct()
    now, sign = Kept(start if known is None else sized(start, known, per), "links"), None
    n = now.df.count()
    for _ in range(rounds):
        near = now.df.toDF("u", "v")
        both = near.union(near.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select("v", "m").union(low.select("u", "m")).distinct().toDF("a", "b")
        new = Kept(sized(small, n, per), "links")
        now.drop()
        now = new
        seen = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == sign:
            return now
        n, sign = seen[0], seen
    raise RuntimeError("components did not settle")
