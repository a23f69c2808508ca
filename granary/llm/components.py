"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of `links` (a, b: long).

    Each round takes the smallest root among a node's neighbours and then the root of that root, so the rounds grow
    with the logarithm of a component's width. Smallest roots are found by partial aggregation and roots are looked up
    by joins that Spark may split, so a node that very many others link to overloads no task. Every round is a written
    table in the shared folder; the tables of earlier rounds are deleted.
    """
    links = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("next")))
    held = staged(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("root")), "roots")
    while True:
        roots = held.select("node", "root")
        known = roots.select(F.col("node").alias("next"), F.col("root").alias("near"))
        nearest = both.join(known, "next").groupBy("node").agg(F.min("near").alias("near"))
        moved = staged(roots.join(nearest, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "near")
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = staged(moved.join(jump, "root").select("node", "was", F.least("root", "up").alias("root")), "roots")
        discard(held, moved)
        held = new
        if new.filter("root <> was").isEmpty():
            discard(links)
            return new.select("node", "root")
