"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut


def components(links: DataFrame) -> DataFrame:
    """From (a, b) to (id, component): the smallest id reachable, for all ids that have a link.

    Each round takes the smallest label of a node's neighbours, then follows labels of labels twice, so that long
    chains shorten fast. Minima are aggregated before they are shuffled; a node with very many links is no hot spot.
    """
    both = links.filter("a != b").select("a", "b").union(links.filter("a != b").select("b", "a"))
    edges = cut(both.distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        for _ in range(2):
            # Dealt anew, though it lies by id already: only then can Spark split the many nodes of one label.
            up = new.select(F.negative(F.negative("id")).alias("component"), F.col("component").alias("up"))
            new = new.join(up, "component", "left").select("id", "old", F.least("component", "up").alias("component"))
        new = cut(new)
        if new.filter("component != old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
