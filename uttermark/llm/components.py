"""Connected components of links, by union-find in parts and star contraction across them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from uttermark.llm.common import discard, stored

FEW = 50_000  # links that one task takes together, some megabytes


def _forest(pairs):
    """Union-find over the links of one partition: (node, smallest node of its tree)."""
    parent: dict = {}

    def root(x):
        path = []
        while (up := parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def local_forests(links: DataFrame) -> DataFrame:
    """Links (u, v) of each partition, replaced by a forest with the same components."""
    kind = links.schema["u"].dataType.simpleString()

    def run(frames):
        pairs = [p for f in frames for p in zip(f["u"], f["v"], strict=True)]
        if pairs:
            yield pd.DataFrame(_forest(pairs), columns=["u", "v"])

    return links.mapInPandas(run, f"u {kind}, v {kind}")


def _told(edges: DataFrame, name: str):
    """The edges, stored, and their number and sum of hashes, found while they were written."""
    seen = Observation()
    mark = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    out = stored(edges.observe(seen, F.count("*").alias("n"), mark.alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that is in a link; the root is the smallest node.

    Large-star and small-star steps in turn, both in one plan a round: every node tells its
    neighbours the smallest node it knows.  A node's neighbours are never gathered, only their
    minimum; the number of rounds is about the logarithm of the longest path.  Once few links are
    left, union-find over all of them ends the rounds.
    """
    edges, now = _told(local_forests(links.select("u", "v").where("u != v")).distinct(), "links")
    before = None
    while now[0] and now != before:
        if now[0] <= FEW:
            last, edges = edges, stored(local_forests(edges.coalesce(1)), "forest")
            discard(last)
            break
        last, before = edges, now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u > v on every edge from here.
        down = large.where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        near = down.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges, now = _told(small.distinct(), "stars")
        discard(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after further links between their nodes.

    Only links between different roots count, and they are few once most nodes are settled: their
    components are found on the roots, and the roots of all nodes are looked up there.
    """
    end = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}"))
    new = links.join(end("u"), "u").join(end("v"), "v").where("r_u != r_v")
    new = stored(new.select(F.col("r_u").alias("u"), F.col("r_v").alias("v")).distinct(), "new-links")
    if new.isEmpty():
        return labels
    to = components(new).select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = stored(labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
    discard(labels)
    return out
