"""Connected components of a link graph by contraction, with DataFrame operations only.

Each round points every vertex at the smallest vertex next to it, shortens the pointers, and contracts the links by them.
A pointer never rises, so the last vertex of a component is its smallest. Rounds go on while links are left between
different vertices; their number grows with the logarithm of the longest path. Minima are partial aggregations, and the
joins on a vertex are plain equality joins that the optimiser can split at a vertex with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex of a link; component is the smallest vertex reachable.

    Links are undirected, may repeat and may join a vertex to itself; rows with a null end are no links.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node"))
    first = True
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        # (vertex, smallest of it and its neighbours); then one shortening: the pointer of the pointer
        point = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        point = materialize(point)
        again = point.select(F.col("a").alias("via"), F.col("low").alias("lower"))
        point = materialize(point.join(again, F.col("low") == F.col("via"), "left").select("a", F.coalesce("lower", "low").alias("low")))
        labels = labels.join(point, F.col("component") == F.col("a"), "left").select("node", F.coalesce("low", "component").alias("component"))
        to = lambda v, n: point.select(F.col("a").alias(v), F.col("low").alias(n))
        moved = edges.join(to("pa", "na"), F.col("a") == F.col("pa"), "inner").join(to("pb", "nb"), F.col("b") == F.col("pb"), "inner")
        moved = moved.filter("na <> nb").select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct()
        edges = materialize(moved)
        labels = materialize(labels)
        first = False
    return materialize(labels) if first else labels
