"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, settle


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (a, b) the table (node, component): the smallest node of each component, for every node that has a link.

    Large stars and small stars by turns: each node hangs its greater neighbours on the smallest one
    it knows, then itself and its smaller neighbours. Every round writes its links to the shared
    folder. Groups are only ever reduced to a minimum, and the joins start from written tables, so a
    hub of any size can be split. Links from a node to itself are ignored.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = settle(now, "links")
    mark = None
    for _ in range(rounds):
        # Large star: both directions; every greater neighbour is joined to the node's minimum.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "links")
        old = [now, low]
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        big = settle(big, "links")
        # Small star: smaller neighbours (all are, now) and the node itself are joined to the smallest.
        low = settle(big.groupBy("a").agg(F.min("b").alias("low")), "links")
        old += [big, low]
        rest = big.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = settle(rest.union(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        discard(*old)
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (found.n, found.h):
            break
        mark = (found.n, found.h)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", F.col("b").alias("c")).distinct())
