"""Connected components by alternating large-star and small-star over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.shared import written

SALTS = 256
PART_LINKS, LEAST_PARTS = 200_000, 8  # links of a partition: a small table isn't cut into hundreds of tasks
#: Up to so many links, counted in each round, the smallest neighbours (two numbers a node, two nodes a link) are broadcast.
SENT_LINKS = 200_000


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(near: DataFrame, parts: int, few: bool) -> DataFrame:
    """a, b, m: m the smallest b of each a. It goes back by (a, salt), so a hub's links are neither one group nor one join key; where links are few, it is sent to all tasks."""
    if few:
        return near.join(F.broadcast(near.groupBy("a").agg(F.min("b").alias("m"))), "a")
    salted = near.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")).repartition(parts, "a", "salt")
    # At most SALTS rows of an a meet in the window.
    part = salted.groupBy("a", "salt").agg(F.min("b").alias("m")).repartition(parts, "a")
    least = part.select("a", "salt", F.min("m").over(Window.partitionBy("a")).alias("m"))
    return salted.join(least.repartition(parts, "a", "salt"), ["a", "salt"]).select("a", "b", "m")


def _large_star(links: DataFrame, parts: int, few: bool) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and all its neighbours."""
    near = _with_least(_both(links), parts, few).where(F.col("b") > F.col("a"))
    return near.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")


def _small_star(links: DataFrame, parts: int, few: bool) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = _with_least(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), parts, few)
    ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
    pairs = down.select(ends).select("e.a", "e.b").where("a <> b")
    return (pairs if few else pairs.repartition(parts, "a", "b")).distinct()


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: two rounds with the same are taken to be equal."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the links (a, b) can reach.

    Each round's links are a written table; the driver sees two numbers of it. Rounds grow with the
    logarithm of the number of nodes. A hub's links are dealt by salts, so no task gathers them. No
    links: no rows.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = _mark(now)
    while seen[0]:
        parts = max(LEAST_PARTS, -(-seen[0] // PART_LINKS))
        few = seen[0] <= SENT_LINKS
        now = written(_small_star(_large_star(now, parts, few), parts, few), "links")
        if (mark := _mark(now)) == seen:
            break
        seen = mark
    # Now each node but the least links to the least one.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
