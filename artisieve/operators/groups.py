"""Connected groups of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.sources.staging import staged


def connected(links: DataFrame) -> DataFrame:
    """(v, label) for each end of ``links(a, b)``: the least key that it is connected with.

    Every key hangs itself under the least key it knows of, by turns with its greater and with its smaller neighbours, until
    nothing changes: a logarithm of rounds, each staged. A key's neighbours are only ever reduced to their minimum.
    """
    down = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges = staged(links.where("a <> b").select(*down).distinct(), "groups")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        root = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = staged(both.join(root, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "groups-up")
        root = hung.groupBy("a").agg(F.min("b").alias("m"))
        pairs = hung.join(root, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        edges = staged(pairs.where("a <> b").select(*down).distinct(), "groups-down")
        state = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 32))).first()
        if state == before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
        before = state
