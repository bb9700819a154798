"""Connected components of a table of links, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Alternating large-star and small-star steps: each hangs all neighbours of a node on their
    smallest one, so trees get flatter until every node hangs on its root. No node's neighbours
    are ever gathered in one place; each round is written to the shared folder."""
    e = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        e = stored(e, "links")
        # small star: a node and its smaller neighbours move to the smallest of them (a > b holds here)
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = stored(e, "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
