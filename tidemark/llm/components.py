"""Connected components of a link table by alternating star contractions.

Every round rewrites the links so that each node points at smaller ones (large star, then
small star); after a logarithmic number of rounds every component is a star around its
smallest node, which is tested on all links. Rounds are written to shared tables, and each one
deletes the table before it; links are never gathered anywhere, and each round's joins are plain
equi-joins that adaptive execution can split at a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _stars(links: DataFrame) -> bool:
    """Whether every node points at one other, which is smaller and points nowhere."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), (F.col("a") < F.col("b")).cast("int").alias("up"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"), F.max("up").alias("up"))
    return seen.where("out > 1 OR (out = 1 AND into = 1) OR up = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b), stored; a component is named by its smallest node."""
    held = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    while not _stars(held):
        last, held = held, stored(_small_star(_large_star(held)).distinct(), "links")
        discard(last)
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
