"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) edges of longs to (node, root) rows, root the smallest of its component; roots themselves are left out.

    Alternating large and small stars: every round hangs larger neighbours, then smaller ones, on the least
    neighbour, until nothing changes. Minima combine before the shuffle and come back by joins that can be split,
    so a centre with very many neighbours is no single task's. Each round is a written table.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = scratch.keep(e, "edges0"), None
    for i in count(1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = least.select("u", F.col("m").alias("v")).unionByName(small).distinct()
        e = scratch.keep(hung, f"edges{i}")
        scratch.drop(f"edges{i - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
