"""Connected components of a link table, labelled by their smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


#: Parts that a node's links are dealt into.
SALTS = 256


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m``, the smallest b of each a.

    The links of a node are dealt by their other end, so that those of a hub never meet in one task: each part has its least, and
    only the parts' leasts, ``SALTS`` at most, come together.
    """
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    return dealt.join(parts.withColumn("m", F.min("m").over(Window.partitionBy("a"))), ["a", "salt"]).select("a", "b", "m")


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to one row (id, component) for each id that has a link to another.

    Alternates large-star and small-star steps: each node hooks its larger neighbours, then its smaller ones, to its smallest
    neighbour, until the links are stars. The number of rounds grows with the logarithm of a component's size, and each round's
    links are written to the checkpoint folder. Links with a null end connect nothing; repeated ones count once; an empty table
    gives an empty result.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(around).select("a", "b", F.least("m", "a").alias("m")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large)
        hooked = small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = checkpointed(hooked.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        forked = edges.groupBy("a").count().where("count > 1").select("a")
        deeper = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("b")
        if not forked.union(deeper).limit(1).count():
            break
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
