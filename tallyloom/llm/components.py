"""Distributed union-find: connected components of a link table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, drop


def _large_star(e: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = e.union(e.select("dst", "src"))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours join the smallest of them."""
    least = e.groupBy("src").agg(F.min("dst").alias("m"))
    moved = e.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def _is_forest_of_stars(e: DataFrame) -> bool:
    twice = e.groupBy("src").count().where("count > 1").limit(1)
    inner = e.select(F.col("dst").alias("src")).join(e.select("src"), "src", "left_semi").limit(1)
    return not twice.select("src").union(inner).take(1)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has a link, as a written table; component is the smallest node reachable.

    Nodes are of any type with an order, structs too.

    Alternates large-star and small-star until the links are stars around their smallest node.
    Self-links and links with a null end are ignored; repeated links count once. A node of very
    many links meets only a partial aggregate and a join whose large side can be split.
    """
    a, b = F.col(src), F.col(dst)
    e = cut(edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).where("src <> dst AND src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    for _ in range(max_rounds):
        if _is_forest_of_stars(e):
            break
        old, e = e, cut(_small_star(_large_star(e)), "links")
        drop(old)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    out = cut(e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots), "labels")
    drop(e)
    return out
