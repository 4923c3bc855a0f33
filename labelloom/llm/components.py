"""Connected components of a link table, by alternating star contraction.

Every round is two aggregations and two joins; the tables of a round are
written to the shared folder, so lost executors cost a task, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import materialize


def _lowest(links: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours. Written: its true size then decides how it is joined."""
    low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return materialize(low, "lowest")


def _state(links: DataFrame) -> tuple:
    return links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: each node that has a link, and the smallest node that can be reached from it.

    Nodes may be of any orderable type; nulls and self-links are ignored. No
    neighbourhood is ever gathered: a hub is reduced by partial aggregation
    and met again in a join, which adaptive execution may split.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_lowest(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large = materialize(large, "large-star")
        small = large.join(_lowest(large), "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stays = small.select("u", F.col("m").alias("v"))
        edges = materialize(moved.unionByName(stays).distinct(), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
