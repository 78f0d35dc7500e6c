"""Connected components of links between integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.session import cut


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of all nodes of ``links`` (``a``, ``b``).

    Alternates two steps until nothing changes (Kiveris et al., Connected
    Components in MapReduce and Beyond, 2014).  Large star: every larger
    neighbour of a node is linked to the smallest of the node and its
    neighbours.  Small star: the node and its smaller neighbours are linked to
    the smallest of them.  Both are a minimum per node, combined before the
    shuffle, and a join with it, so no neighbourhood is gathered; the number of
    links never grows.  Every round is written to the shared folder.
    """
    current = _state(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        following = _state(_small_star(_large_star(current[0])))
        if following[1:] == current[1:]:
            break
        current = following
    stars = following[0]
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(links: DataFrame):
    """Distinct links, written once, and what tells whether they changed: their number and a sum of hashes."""
    written = cut(links.distinct(), "components")
    size, total = written.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return written, size, total


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # u is the centre: its larger neighbours move to the smallest.
    larger = links.select(F.col("v").alias("u"), F.col("u").alias("neighbour"))
    return larger.join(least, "u").select(F.col("neighbour").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
