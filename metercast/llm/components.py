"""Connected components of a link table, by large-star and small-star rounds.

Links live in Spark tables only; each round is written to the shared folder,
so that a lost executor repeats one round at most. The driver sees two numbers
for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_dir, written


def connected_components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b: long).

    Nodes whose only links lead to themselves are left out; nulls are ignored.
    """
    folder = folder or work_dir(links.sparkSession)
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "links-0", folder)
    seen, step = None, 0
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, step = state, step + 1
        # large star: every larger neighbour goes to the smallest one (or the node itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"low-{step}", folder)
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
                        f"large-{step}", folder)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), f"least-{step}", folder)
        edges = written(large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"links-{step}", folder)
