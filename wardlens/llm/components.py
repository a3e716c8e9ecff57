"""Connected components of a table of links, by alternating large-star and small-star steps.

No step collects anything: minima are combined before each shuffle, and the links of a hot node are a skewed join that
adaptive execution splits. Each step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a < b. Every node's neighbours are hung on its least neighbour (or itself)."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = near.join(least, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), F.col("b"))
    else:
        out = hung.select(F.col("m").alias("a"), F.col("b")).unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every node but the roots: the least id that it reaches. ``links``: a, b, distinct, a < b."""
    links = written(links, "links")
    before = None
    while True:
        links = written(_star(_star(links, True), False), "stars")
        # A fixed point has every node hung on its root. Sums of hashes tell whether the step changed anything.
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return links.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = now
