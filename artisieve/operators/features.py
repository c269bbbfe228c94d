"""Derived article features and registered domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artisieve.functions import text as X


def client_identity(df: DataFrame, loopback_to_v4: bool = True) -> DataFrame:
    """Adds client_ip and client_hostname: attributes first, else the fourth field of X-Trace and NNTP-Posting-Host."""
    trace = F.regexp_extract(F.coalesce(X.header(F.col("headers"), "X-Trace"), F.lit("")), r"^\S+\s+\d+\s+\d+\s+(\S+)", 1)
    blank = lambda c: F.when(F.trim(c) != "", c)
    ip = F.coalesce(blank(F.col("client_ip")), blank(trace), F.lit(""))
    if loopback_to_v4:
        ip = F.when(ip == "::1", "127.0.0.1").otherwise(ip)
    host = F.coalesce(blank(F.col("client_hostname")), X.header(F.col("headers"), "NNTP-Posting-Host"), F.lit(""))
    return df.withColumns({"client_ip": ip, "client_hostname": host})


def article_features(articles: DataFrame, digest_mode: str = "simple", binary_globs: tuple[str, ...] = ("alt.binaries.*",), scan_bytes: int = 32_768) -> DataFrame:
    """One row of features for each article: groups, type, address, sizes, digest, lines, URLs."""
    groups = X.split_groups(F.col("newsgroups"))
    head = F.create_map(F.lit("From"), F.col("from"), F.lit("Newsgroups"), F.col("newsgroups"), F.lit("Subject"), F.col("subject"), F.lit("Message-ID"), F.col("message_id"))
    body_size, head_size = F.octet_length(F.coalesce("body", F.lit(""))).cast("long"), X.header_size(head)
    return articles.select(
        "article_id",
        groups.alias("groups"),
        F.size(groups).alias("group_count"),
        X.article_type(groups, list(binary_globs)).alias("article_type"),
        X.normalize_email(F.col("from")).alias("from_address"),
        F.sha2(X.digest_input(digest_mode, F.col("subject"), F.col("body"), F.col("newsgroups"), F.col("from"), F.lit(None)), 256).alias("article_digest"),
        X.message_id_hash(F.col("message_id")).alias("message_id_hash"),
        body_size.alias("body_size"),
        head_size.alias("header_size"),
        (body_size + head_size).alias("total_size"),
        F.octet_length(F.substring(F.col("body").cast("binary"), 1, scan_bytes)).alias("scan_size"),
        X.line_statistics(F.col("body")).alias("line_stats"),
        X.urls(F.col("body")).alias("urls"),
    )


def effective(name: str, shared: Column, by_type: dict[str, dict[str, int]], kind: Column) -> Column:
    """A limit or option: the article type's own value where its key exists, else the shared one."""
    out = shared
    for t, values in by_type.items():
        if name in values:
            out = F.when(kind == t, F.lit(values[name])).otherwise(out)
    return out


def skipped(check: str, profile_skips: Column, type_skips: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_contains(F.array_union(F.coalesce(profile_skips, empty), F.coalesce(type_skips, empty)), check)


def applies_to(types: Column, kind: Column) -> Column:
    """Whether a rule is for this article type: no list means all."""
    return types.isNull() | (F.size(types) == 0) | F.array_contains(types, kind)


def registered_domains(hosts: DataFrame, suffixes: DataFrame, host_col: str = "host") -> DataFrame:
    """(host, domain) for each distinct host: the longest listed suffix and one label more. Addresses and single labels
    stay; a host that is itself a suffix stays; without a match, the last two labels."""
    h = hosts.select(F.lower(host_col).alias("host")).where("host IS NOT NULL AND host <> ''").distinct()
    labels = F.split("host", "[.]")
    tails = h.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("pos", "suffix"))
    longest = tails.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.min("pos").alias("pos"))
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(n, F.lit(1)), F.size(labels)), ".")
    is_ip = F.col("host").rlike(r"^\d+(\.\d+){3}$") | F.col("host").contains(":")
    domain = F.when(is_ip | (F.size(labels) == 1), F.col("host")).when(F.col("pos").isNotNull(), tail(F.col("pos"))).otherwise(tail(F.size(labels) - 1))
    return h.join(longest, "host", "left").select("host", domain.alias("domain"))


def article_domains(articles: DataFrame, suffixes: DataFrame, max_urls: int = 20, max_domains: int = 10) -> DataFrame:
    """(article_id, pos, domain): the first distinct registered domains of an article's URLs, in order."""
    found = articles.select("article_id", F.posexplode(X.urls(F.col("body"), max_urls)).alias("pos", "url")).select("article_id", "pos", X.url_host(F.col("url")).alias("host")).where("host <> ''")
    known = registered_domains(found, suffixes)
    first = found.join(known, "host").groupBy("article_id", "domain").agg(F.min("pos").alias("first"))
    w = Window.partitionBy("article_id").orderBy("first")
    return first.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < max_domains).select("article_id", "pos", "domain")
