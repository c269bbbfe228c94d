"""Local distribution passed down reply threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_threads(posts: DataFrame, allowed: tuple[str, ...] = ("local", "usenet"), max_rounds: int = 10_000) -> DataFrame:
    """(message_id, local, legacy_code): whether a post is local, and 108 for a distribution that is not allowed.

    ``posts``: message_id, parent_id, distribution, accepted, ord. A post is local by its own mark, or by a parent that is
    accepted, earlier and local, unless it is marked for the whole net. Ancestors are followed by pointer doubling,
    so that a thread of depth d takes log2(d) shuffled rounds, each staged.
    """
    from artisieve.sources.staging import staged

    value = F.lower(F.trim(F.coalesce("distribution", F.lit(""))))
    bad = (value != "") & ~value.isin(*allowed)
    p = posts.select("message_id", "parent_id", "ord", (F.col("accepted") & ~bad).alias("ok"), F.when(value == "local", True).when((value != "") , False).alias("own"), F.when(bad, 108).otherwise(0).alias("legacy_code"))
    # A post with no mark points at its parent where that one is accepted and earlier; else it is not local.
    parent = p.select(F.col("message_id").alias("parent_id"), F.col("ord").alias("p_ord"), F.col("ok").alias("p_ok"))
    linked = p.join(parent, "parent_id", "left").withColumn("next", F.when(F.col("own").isNull() & F.col("p_ok") & (F.col("p_ord") < F.col("ord")), F.col("parent_id")))
    state = staged(linked.select("message_id", F.coalesce("own", F.when(F.col("next").isNull(), False)).alias("local"), "next", "legacy_code"), "threads")
    for _ in range(max_rounds):
        if state.where("local IS NULL").limit(1).count() == 0:
            return state.select("message_id", "local", "legacy_code")
        up = state.select(F.col("message_id").alias("next"), F.col("local").alias("u_local"), F.col("next").alias("u_next"))
        open_ = state.where("local IS NULL").join(up, "next", "left")
        moved = open_.select("message_id", "u_local", "u_next", "legacy_code").select("message_id", F.coalesce("u_local", F.when(F.col("u_next").isNull(), False)).alias("local"), F.col("u_next").alias("next"), "legacy_code")
        state = staged(state.where("local IS NOT NULL").unionByName(moved), "threads")
    raise RuntimeError("threads did not settle")
