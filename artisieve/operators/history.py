"""Queries, reports and retention over the event log. All are plain aggregations and top-k; ties are broken fully."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000

flag = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("long")
is_result = lambda name: F.col("nntp_result") == name
audited = lambda: F.col("audit_mode") & F.col("would_reject")


def since(events: DataFrame, now_us: int, hours: int) -> DataFrame:
    """Events at most ``hours`` old; the bound is a literal, so that it reaches the scan."""
    return events.where(F.col("received_us") >= now_us - hours * HOUR_US)


def query_events(events: DataFrame, limit: int = 100, since_us: int | None = None, **equals: object) -> DataFrame:
    """The newest events that meet the equality filters. ``limit`` below 1 means 100, above 10000 means 10000.
    A filter of None is not applied."""
    for name, value in equals.items():
        if value is not None:
            events = events.where(F.col(name) == F.lit(value))
    if since_us is not None:
        events = events.where(F.col("received_us") >= since_us)
    return events.orderBy(F.desc("received_us"), F.desc("id")).limit(min(limit, 10_000) if limit >= 1 else 100)


def stats(events: DataFrame) -> DataFrame:
    return events.groupBy("article_type", "nntp_result", "technical_verdict").agg(F.count("*").alias("count"))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"), flag(is_result("accepted")).alias("accepted"), flag(is_result("rejected")).alias("rejected"), flag(is_result("discarded")).alias("discarded"), flag(audited()).alias("audit_would_reject"), flag(F.col("tor")).alias("tor"), F.round(F.avg("elapsed_ms"), 6).alias("avg_elapsed_ms"), F.max("elapsed_ms").alias("max_elapsed_ms"))


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("article_type").agg(F.count("*").alias("total"), flag(is_result("accepted")).alias("accepted"), flag(is_result("rejected")).alias("rejected"), flag(is_result("discarded")).alias("discarded"), flag(audited()).alias("audit"))


def top_reasons(events: DataFrame, k: int = 20) -> DataFrame:
    keys = ["article_type", "reason_code", "legacy_code", "reason_text"]
    return events.where("technical_verdict = 'reject'").groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys).limit(k)


def top_rules(events: DataFrame, hits: DataFrame, k: int = 20) -> DataFrame:
    """Hits of the events, by rule. Only ids of the events enter the join."""
    joined = hits.join(events.select(F.col("id").alias("event_id")), "event_id")
    return joined.groupBy("rule_id").agg(F.count("*").alias("count"), F.sum("score").alias("score")).orderBy(F.desc("count"), "rule_id").limit(k)


def hourly(events: DataFrame) -> DataFrame:
    """Activity by hour of the session time zone."""
    bucket = F.date_format(F.timestamp_micros("received_us"), "yyyy-MM-dd HH:00").alias("bucket")
    return events.groupBy(bucket).agg(F.count("*").alias("total"), flag(is_result("accepted")).alias("accepted"), flag(is_result("rejected")).alias("rejected"), flag(audited()).alias("audit"))


def top_identities(events: DataFrame, k: int = 20, ip_lookup: str = "client_ip", user_lookup: str = "auth_user", shown: tuple[str, ...] = ("client_ip", "auth_user")) -> DataFrame:
    """The busiest (address, user) lookups; what is shown comes from the newest event of each, without a join back."""
    grouped = events.groupBy(F.col(ip_lookup).alias("__ip"), F.col(user_lookup).alias("__user")).agg(F.count("*").alias("count"), flag(F.col("technical_verdict") == "reject").alias("rejected"), F.max_by(F.struct(*shown), "id").alias("sample"))
    return grouped.orderBy(F.desc("count"), "__ip", "__user").limit(k).select("sample.*", "count", "rejected")


def saved_list(saved: DataFrame, events: DataFrame, article_type: str | None = None, limit: int = 100) -> DataFrame:
    """Saved rejects with their codes, newest first; a saved row whose event is gone keeps nulls."""
    if article_type is not None:
        saved = saved.where(F.col("article_type") == article_type)
    newest = saved.orderBy(F.desc("created_us"), F.desc("event_id")).limit(limit)
    codes = events.select(F.col("id").alias("event_id"), "reason_code", "legacy_code")
    return newest.join(codes, "event_id", "left")


def saved_show(saved: DataFrame, event_id: int) -> DataFrame:
    return saved.where(F.col("event_id") == event_id)


def purge_preview(events: DataFrame, before_us: int) -> DataFrame:
    return events.where(F.col("received_us") < before_us).agg(F.count("*").alias("count"))


def purge(events: DataFrame, hits: DataFrame, saved: DataFrame, before_us: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left after a purge: (events, hits, saved, action row). Hits go with their events; saved rows stay
    without the link. The action row is made lazily from the purged count."""
    gone = events.where(F.col("received_us") < before_us).select(F.col("id").alias("event_id"))
    kept_saved = saved.join(gone.withColumn("__gone", F.lit(True)), "event_id", "left").withColumn("event_id", F.when(F.col("__gone"), None).otherwise(F.col("event_id"))).drop("__gone")
    action = gone.agg(F.lit("purge_events").alias("action"), F.lit(before_us).alias("before_us"), F.count("*").alias("affected"))
    return events.where(~(F.coalesce(F.col("received_us"), F.lit(before_us)) < before_us)), hits.join(gone, "event_id", "left_anti"), kept_saved.select(*saved.columns), action


def merge_history(*versions: DataFrame) -> DataFrame:
    """Event tables of several schema versions as one; older rows are plain text articles."""
    out = versions[0]
    for df in versions[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    for name, default in (("identity_storage_mode", "plain"), ("article_type", "text")):
        value = F.coalesce(F.col(name), F.lit(default)) if name in out.columns else F.lit(default)
        out = out.withColumn(name, value)
    return out
