"""Article sources and sinks: text files of headers and body, lists, audit tables, exports and rule output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from artisieve.functions import text as X
from artisieve.sources.commits import CommitLog

ARTICLE_SCHEMA = "article_id long, received_us long, headers map<string,string>, body string, client_ip string, client_hostname string, interface string, user string"


def parse_article(raw: Column) -> Column:
    """Struct (headers, body) of an article's text: split at the first blank line; a line that starts with a blank continues
    the header before it; lines without a colon are ignored; of repeated headers the last holds."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "\r\n", "\n")
    head = F.when(text.startswith("\n"), "").otherwise(F.regexp_extract(text, r"(?s)\A(.*?)(?:\n\n|\z)", 1))
    body = F.when(text.startswith("\n"), F.substring(text, F.lit(2), F.length(text))).otherwise(F.substring(text, F.length(head) + 3, F.length(text)))
    lines = F.split(F.regexp_replace(head, r"\n([ \t])", "\0$1"), "\n")
    entries = F.transform(F.filter(lines, lambda x: x.rlike(r"^[^:\s][^:]*:")), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("key"), F.replace(F.regexp_replace(x, r"^[^:]*:[ \t]*", ""), F.lit("\0"), F.lit("\n")).alias("value")))
    empty = F.create_map().cast("map<string,string>")
    headers = F.aggregate(entries, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
    return F.struct(headers.alias("headers"), body.alias("body"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, body) of article files."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("raw"))
    return raw.select("file", parse_article(F.col("raw")).alias("a")).select("file", "a.*")


def stream_articles(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA, max_files: int = 100) -> DataFrame:
    """A stream of article rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def read_active_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group): the first word of each line."""
    return spark.read.text(path).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("group")).where("group <> ''").distinct()


def read_senders(spark: SparkSession, path: str) -> DataFrame:
    """(group, sender) from ``GROUP.dat`` files: comments cut, trimmed, lower-case."""
    rows = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.dat$", "").alias("group"), F.lower(F.trim(F.regexp_replace("value", r"#.*$", ""))).alias("sender"))
    return rows.where("sender <> ''").distinct()


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(suffix) of a public suffix list: comments and exceptions skipped, a leading ``*.`` dropped."""
    value = F.trim(F.regexp_replace("value", r"(?://|#).*$", ""))
    rows = spark.read.text(path).select(F.lower(F.regexp_replace(value, r"^\*\.", "")).alias("suffix"))
    return rows.where("suffix <> '' AND NOT startswith(suffix, '!')").distinct()


def serialize(headers: Column, body: Column) -> Column:
    """An article's text: headers sorted without case, without ``__*``, null and empty ones; folds by a tab; blank line; body."""
    kept = F.filter(F.map_entries(headers), lambda e: ~e["key"].startswith("__") & e["value"].isNotNull() & (e["value"] != ""))
    ordered = F.array_sort(F.transform(kept, lambda e: F.struct(F.lower(e["key"]).alias("low"), e["key"].alias("key"), e["value"].alias("value"))))
    lines = F.transform(ordered, lambda e: F.concat(e["key"], F.lit(": "), F.regexp_replace(e["value"], r"\r?\n[ \t]*", "\n\t"), F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit("\n"), F.coalesce(body, F.lit("")))


def saved_rows(articles: DataFrame) -> DataFrame:
    """(event_id, article_type, path, file_sha256, file_size, created_us, content) of articles to be saved.

    ``articles``: event_id, article_type, received_us, legacy_code, reason_code, reason_text, message_id, headers, body. Three
    diagnostic headers are added to the saved copy only. The path comes from the receipt time, so that reruns agree.
    """
    seconds, micros = F.floor(F.col("received_us") / 1_000_000), F.pmod(F.col("received_us"), F.lit(1_000_000))
    day = F.date_format(F.timestamp_micros("received_us"), "yyyy/MM/dd")
    path = F.concat(F.col("article_type"), F.lit("/"), day, F.lit("/"), F.format_string("%d.%06d.%s.%s.post", seconds, micros, "reason_code", X.message_id_hash(F.col("message_id"))))
    extra = F.create_map(F.lit("X-Reject-Code"), F.col("reason_code"), F.lit("X-Reject-Number"), F.col("legacy_code").cast("string"), F.lit("X-Reject-Reason"), F.col("reason_text"))
    content = serialize(F.map_concat(F.map_filter("headers", lambda k, _: ~k.isin("X-Reject-Code", "X-Reject-Number", "X-Reject-Reason")), extra), F.col("body"))
    rows = articles.select("event_id", "article_type", path.alias("path"), F.col("received_us").alias("created_us"), content.alias("content"))
    return rows.select("event_id", "article_type", "path", F.sha2("content", 256).alias("file_sha256"), F.octet_length("content").cast("long").alias("file_size"), "created_us", "content")


PARTITIONS = {"article_events": ["received_date", "article_type"], "saved": ["article_type", "day"]}


def record_batch(events: DataFrame, hits: DataFrame, path: str, batch: int | str, saved: DataFrame | None = None) -> bool:
    """Records one batch of events, their hits and their saved rows in the commit log ``path``: all of them or none, and once,
    however often the batch is run. False where the batch was recorded before."""
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")
    tables = {"article_events": events.withColumn("received_date", day("received_us")), "rule_hits": hits}
    if saved is not None:
        tables["saved"] = saved.withColumn("day", day("created_us"))
    return CommitLog(events.sparkSession, path).commit(str(batch), tables, partitions=PARTITIONS)


def write_saved(rows: DataFrame, path: str, batch: int | str) -> bool:
    """Adds saved rows to the commit log ``path``, split by type and day; once for each batch."""
    day = F.date_format(F.timestamp_micros("created_us"), "yyyy-MM-dd")
    return CommitLog(rows.sparkSession, path).commit(str(batch), {"saved": rows.withColumn("day", day)}, partitions=PARTITIONS)


def write_events(events: DataFrame, hits: DataFrame, path: str, batch: int | str) -> bool:
    """Writes one batch of events and hits together; a batch that is run again is recorded once."""
    return record_batch(events, hits, path, batch)


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, hits) of all committed batches."""
    log = CommitLog(spark, path)
    return log.read("article_events"), log.read("rule_hits")


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    return CommitLog(spark, path).read("saved")


def jsonl(df: DataFrame, order: str = "received_us") -> DataFrame:
    """(order, line): canonical JSON, keys sorted, nulls kept."""
    cols = sorted(df.columns)
    return df.select(F.col(order), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("line"))


def export_jsonl(df: DataFrame, path: str, order: str = "received_us") -> None:
    jsonl(df, order).orderBy(order).select("line").write.text(path)


def csv_line(df: DataFrame) -> DataFrame:
    """(line): every field quoted, quotes doubled, null as ''; columns sorted by name."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return df.select(F.concat_ws(",", *[quote(c) for c in sorted(df.columns)]).alias("line"))


def export_csv(df: DataFrame, path: str, order: str = "received_us") -> None:
    """CSV files with a header each, ordered; an empty table writes no header."""
    sorted_ = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(df.columns)]).orderBy(F.col(order).cast("long"))
    sorted_.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def rule_log_lines(hits: DataFrame) -> DataFrame:
    """(rule_id, line): ``time rule= action= message_id= message=`` for rules that write to a file.

    ``hits``: rule_id, action, message_id, message, received_us."""
    stamp = F.date_format(F.timestamp_micros("received_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return hits.select("rule_id", F.format_string("%s rule=%s action=%s message_id=%s message=%s", stamp, "rule_id", "action", F.coalesce("message_id", F.lit("")), F.coalesce("message", F.lit(""))).alias("line"))


def file_records(articles: DataFrame) -> DataFrame:
    """(file_name, content): one file an article, named by time and message-id hash."""
    name = F.format_string("%d.%06d.%d.%s", F.floor(F.col("received_us") / 1_000_000), F.pmod(F.col("received_us"), F.lit(1_000_000)), F.col("article_id"), X.message_id_hash(F.col("message_id")))
    return articles.select(name.alias("file_name"), serialize(F.col("headers"), F.col("body")).alias("content"))


def rnews_record(article: Column) -> Column:
    """``#! rnews <bytes>`` and the article."""
    return F.concat(F.lit("#! rnews "), F.octet_length(article).cast("string"), F.lit("\n"), article)


def mbox_record(article: Column, sender: Column, received_us: Column) -> Column:
    """A mailbox record: the From line, the article with its own From lines quoted, a blank line."""
    stamp = F.date_format(F.timestamp_micros(received_us), "EEE MMM d HH:mm:ss yyyy")
    return F.concat(F.lit("From "), sender, F.lit(" "), stamp, F.lit("\n"), F.regexp_replace(article, r"(?m)^From ", ">From "), F.lit("\n"))
