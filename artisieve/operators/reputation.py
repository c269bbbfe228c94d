"""Reputation joins against listing tables (provider, key, rcode, answers) in place of live lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artisieve.functions import text as X
from artisieve.operators.rules import cidr_matches, small

TIMEOUTS = ["TIMEOUT", "SERVFAIL"]


def classify(listing_rcode: Column, answers: Column, positive: Column, refused: Column) -> Column:
    """``listed``, ``clean`` or ``error`` of one lookup: an unknown name is clean, another rcode an error, a refused answer an
    error and no listing; else any positive answer lists, or any answer where no positive codes are named."""
    none = F.array().cast("array<string>")
    answers, positive, refused = F.coalesce(answers, none), F.coalesce(positive, none), F.coalesce(refused, none)
    return (
        F.when(listing_rcode.isNull() | (listing_rcode == "NXDOMAIN"), "clean").when(listing_rcode != "NOERROR", "error")
        .when(F.arrays_overlap(answers, refused), "error").when(F.size(answers) == 0, "clean")
        .when((F.size(positive) == 0) | F.arrays_overlap(answers, positive), "listed").otherwise("clean")
    )


def lookups(keys: DataFrame, providers: DataFrame, listings: DataFrame) -> DataFrame:
    """(article_id, pos, provider, ord, action, status, timed_out, reject_on_failure): each key at each provider.

    ``keys``: article_id, pos, key, family (null for names). Providers are few and broadcast; listings join on
    (provider, key), distinct keys once."""
    p = small(providers).select(F.col("id").alias("provider"), "ord", "zone", "ip_versions", "positive_codes", "refused_codes", "action", "on_error", "on_timeout")
    wanted = keys.join(p, F.col("family").isNull() | F.col("ip_versions").isNull() | F.array_contains("ip_versions", F.col("family")))
    found = wanted.join(listings.select("provider", "key", "rcode", "answers").dropDuplicates(["provider", "key"]), ["provider", "key"], "left")
    status = classify(F.col("rcode"), F.col("answers"), F.col("positive_codes"), F.col("refused_codes"))
    late = F.coalesce(F.col("rcode").isin(*TIMEOUTS), F.lit(False))
    policy = F.when(late, F.coalesce("on_timeout", F.lit("accept"))).otherwise(F.coalesce("on_error", F.lit("accept")))
    return found.select("article_id", "pos", "provider", "ord", F.coalesce("action", F.lit("reject")).alias("action"), F.concat_ws(".", "key", "zone").alias("query"), status.alias("status"), late.alias("timed_out"), ((status == "error") & (policy == "reject")).alias("reject_on_failure"))


def ip_keys(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", F.lit(0).alias("pos"), X.reverse_ip(F.col("client_ip")).alias("key"), X.ip_key(F.col("client_ip"))["family"].alias("family")).where("key IS NOT NULL")


def domain_keys(domains: DataFrame) -> DataFrame:
    return domains.select("article_id", "pos", F.col("domain").alias("key"), F.lit(None).cast("int").alias("family"))


def first_rejection(found: DataFrame, code: int) -> DataFrame:
    """(article_id, legacy_code, provider): the first provider in order whose listing or failure rejects."""
    rejecting = found.where("(status = 'listed' AND action = 'reject') OR reject_on_failure")
    return rejecting.groupBy("article_id").agg(F.min(F.struct("ord", "pos", "provider")).alias("x")).select("article_id", F.lit(code).alias("legacy_code"), F.col("x.provider").alias("provider"))


def tor_clients(articles: DataFrame, networks: DataFrame, found: DataFrame, action: str = "mark") -> DataFrame:
    """(article_id, tor, legacy_code): local networks first, else the list; ``reject`` gives 50, others only mark."""
    local = cidr_matches(articles, networks).select(F.col("ip").alias("client_ip")).distinct()
    inside = articles.select("article_id", "client_ip").join(local, "client_ip", "left_semi").select("article_id")
    listed = found.where("status = 'listed'").select("article_id")
    return inside.union(listed).distinct().select("article_id", F.lit(True).alias("tor"), F.lit(50 if action == "reject" else 0).alias("legacy_code"))


def provider_health(log: DataFrame, threshold: int = 5, cooldown_us: int = 300_000_000, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Adds to a lookup log (provider, ts_us, id, ok) the failures since the last success and whether the
    provider was cooling down: within ``cooldown_us`` of an earlier failure that reached the threshold.

    Rows are ordered inside time buckets of a provider only; what earlier buckets pass on (the failures since their last
    success, their last strike) comes from one summary row a bucket.
    """
    bucket = F.expr(f"(ts_us - pmod(ts_us, {bucket_us}L)) div {bucket_us}L")
    within, order = Window.partitionBy("provider", "__bucket"), ["ts_us", "id"]
    along = Window.partitionBy("provider").orderBy("__bucket")
    log = log.withColumn("__bucket", bucket).withColumn("__oks", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(within.orderBy(*order)))
    log = log.withColumn("__run", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("provider", "__bucket", "__oks").orderBy(*order)))

    def passed_on(rows: DataFrame, summary: DataFrame) -> DataFrame:
        right = summary.select(F.col("provider").alias("__p"), F.col("__bucket").alias("__b"), "__carry")
        return rows.join(right, F.col("provider").eqNullSafe(F.col("__p")) & F.col("__bucket").eqNullSafe(F.col("__b")), "left").drop("__p", "__b")

    ends = log.groupBy("provider", "__bucket").agg((F.max("__oks") > 0).cast("int").alias("__ok"), F.max_by("__run", F.struct(*order)).alias("__last")).withColumn("__era", F.sum("__ok").over(along))
    ends = ends.withColumn("__since", F.sum("__last").over(Window.partitionBy("provider", "__era").orderBy("__bucket"))).withColumn("__carry", F.lag("__since").over(along))
    log = passed_on(log, ends).withColumn("failures", F.col("__run") + F.when(F.col("__oks") == 0, F.coalesce("__carry", F.lit(0))).otherwise(0)).drop("__carry")
    strike = F.when(F.col("failures") >= threshold, F.col("ts_us"))
    strikes = log.groupBy("provider", "__bucket").agg(F.max(strike).alias("__last")).withColumn("__carry", F.max("__last").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    mine = F.max(strike).over(within.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    log = passed_on(log.withColumn("__mine", mine), strikes)
    return log.withColumn("suppressed", F.coalesce(F.col("ts_us") - F.greatest("__mine", "__carry") < cooldown_us, F.lit(False))).drop("__bucket", "__oks", "__run", "__mine", "__carry")


def lookup_dedupe(requests: DataFrame, positive_us: int = 3_600_000_000, negative_us: int = 300_000_000) -> DataFrame:
    """Adds ``cached`` to requests (provider, key, ts_us, id, listed): the request before of the same key is within its
    time to live."""
    w = Window.partitionBy("provider", "key").orderBy("ts_us", "id")
    life = F.when(F.lag("listed").over(w), positive_us).otherwise(negative_us)
    return requests.withColumn("cached", F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) < life, F.lit(False)))
