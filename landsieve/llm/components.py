"""Connected components of a graph given as links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsieve.llm.common import written


def _to_least(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), every b beside the least b of its a (``m``); dealt by a once."""
    return pairs.repartition("a").distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node that can be reached.

    Alternates the two star steps: each node hands its larger neighbours, then its smaller ones, to its least
    neighbour. A chain of n links takes about log n rounds; each is two shuffles, and is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        small = _to_least(large)
        # the least of a node's pairs becomes its own link, the others hand their ends on
        small = small.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
