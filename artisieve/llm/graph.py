"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(v, label) for each endpoint of ``links(a, b)``; label is the least vertex of its component.

    Alternates large-star and small-star steps, each staged, until the links stop changing; a hub's links
    are only ever aggregated to a minimum, so no group is gathered.
    """
    one_way = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = staged(links.where("a <> b").select(*one_way).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where("a <> b").select(*one_way).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
