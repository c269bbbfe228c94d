"""The driver's tables read as this library's inputs: articles, events, rule hits and reply threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artisieve.functions.codes import with_reason


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: one row an article, from the ``events`` table."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    error, audit = F.col("event_type") == "error", F.col("user_id") % 2 == 0
    rows = e.select(
        F.col("event_id").alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("received_us"),
        F.concat(F.lit("u"), F.col("user_id")).alias("auth_user"),
        F.concat(F.lit("198.51.100."), F.col("user_id") % 40).alias("client_ip"),
        F.when(F.col("event_type") == "purchase", "binary").otherwise("text").alias("article_type"),
        F.when(error, "reject").otherwise("pass").alias("technical_verdict"),
        audit.alias("audit_mode"),
        F.when(error & audit, "accepted").when(error & (k >= 90), "discarded").when(error, "rejected").otherwise("accepted").alias("nntp_result"),
        error.alias("would_reject"),
        F.when(error, 1 + k % 90).otherwise(0).cast("int").alias("legacy_code"),
        F.round(F.col("value") * 100).cast("long").alias("total_size"),
        (1 + k % 5).alias("group_count"),
        (k % 3).alias("followup_count"),
        (F.col("user_id") % 25 == 0).alias("tor"),
        F.col("value").alias("elapsed_ms"),
        F.sha2(F.concat_ws("-", F.col("user_id").cast("string"), k.cast("string")), 256).alias("article_digest"),
        F.col("user_id"),
        k.alias("k"),
    )
    rows = with_reason(rows).withColumnRenamed("message", "reason_text")
    return rows.withColumn("reason_code", F.when(F.col("legacy_code") == 0, "PF-ACCEPT-000").otherwise(F.col("reason_code")))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("technical_verdict = 'reject'")
    return e.select(F.col("id").alias("event_id"), F.concat(F.lit("rule-"), F.col("k") % 12).alias("rule_id"), F.lit("body").alias("target"), (F.col("k") % 20).cast("double").alias("score"), F.lit("score").alias("action"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from ``documents``: headers as a map, payloads added to some bodies."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    group = F.concat_ws(".", "lang", "source")
    base64 = F.lit("\n".join(["A" * 64] * 100))
    body = F.col("text")
    signed = F.concat(F.lit("\n-----BEGIN PGP SIGNATURE-----\n"), base64, F.lit("\n-----END PGP SIGNATURE-----"))
    body = F.when(n % 26 == 0, F.concat(body, signed)).when(n % 13 == 0, F.concat(body, F.lit("\n"), base64)).otherwise(body)
    body = F.when(n % 19 == 0, F.concat(body, F.lit("\n=ybegin line=128 size=4 name=x"))).otherwise(body)
    body = F.when(n % 17 == 0, F.concat(F.lit("> "), F.replace(body, F.lit("\n"), F.lit("\n> ")))).otherwise(body)
    return d.select(
        n.alias("article_id"),
        F.concat(F.lit("<doc"), n, F.lit("@fixture.invalid>")).alias("message_id"),
        F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 60).alias("subject"),
        F.concat(F.col("source"), F.lit(" <"), F.col("source"), F.lit("@"), F.col("lang"), F.lit(".example.org>")).alias("from"),
        F.when(n % 10 == 5, F.concat(F.lit("alt.binaries."), F.col("source"))).when(n % 10 == 0, F.concat(group, F.lit(",alt.binaries."), F.col("source"))).otherwise(group).alias("newsgroups"),
        F.concat(F.lit("172."), 16 + n % 20, F.lit(".5.9")).alias("client_ip"),
        (F.lit(1704067200000000) + n * 60000000).alias("received_us"),
        body.alias("body"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply threads from ``conversations``: parent is the turn before."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    mid = lambda turn: F.concat(F.lit("<c"), F.col("conv_id"), F.lit("-"), turn, F.lit("@fixture.invalid>"))
    return c.select(
        mid(F.col("turn")).alias("message_id"),
        F.when(F.col("turn") > 0, mid(F.col("turn") - 1)).alias("parent_id"),
        F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "local").when((F.col("turn") == 3) & (F.col("conv_id") % 6 == 0), "usenet").otherwise("").alias("distribution"),
        F.lit(True).alias("accepted"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )


def pages_as_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles whose body is the URL, a line end and the HTML."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("article_id"), F.concat_ws("\n", "url", "html").alias("body"))
