"""Files in and out, and streams against the batch result."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from artisieve.operators import rates, reputation
from artisieve.sources import articles as A
from artisieve.streaming import scoring


def test_article_files(spark, tmp_path):
    (tmp_path / "a.post").write_bytes(b"From: a@b.c\r\nSubject: one\r\n\ttwo\r\nnonsense\r\nSubject: last\r\n\r\nbody\r\n\r\nmore")
    (tmp_path / "b.post").write_text("X: 1\n y\n z\n\n")
    got = {r.file.rsplit("/", 1)[1]: (r.headers, r.body) for r in A.read_articles(spark, str(tmp_path)).collect()}
    assert got["a.post"] == ({"From": "a@b.c", "Subject": "last"}, "body\n\nmore")
    assert got["b.post"] == ({"X": "1\n y\n z"}, "")


def test_lists(spark, tmp_path):
    (tmp_path / "active").write_text("a.b 1 2 y\n  c.d x\n\n")
    assert sorted(r.group for r in A.read_active_groups(spark, f"{tmp_path}/active").collect()) == ["a.b", "c.d"]
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists/a.b.dat").write_text("# none\n X@Y.z # me\n\n")
    assert [(r.group, r.sender) for r in A.read_senders(spark, f"{tmp_path}/lists").collect()] == [("a.b", "x@y.z")]
    (tmp_path / "suffixes").write_text("// c\n*.ck\n!www.ck\nCo.uk # x\n")
    assert sorted(r.suffix for r in A.read_suffixes(spark, f"{tmp_path}/suffixes").collect()) == ["ck", "co.uk"]


def test_serialise_and_parse(spark):
    df = spark.createDataFrame([({"b": "1", "A": "x\n  y", "__z": "q", "n": None, "e": ""}, "body\n")], "headers map<string,string>, body string")
    text = df.select(A.serialize(F.col("headers"), F.col("body")).alias("t")).first()["t"]
    assert text == "A: x\n\ty\nb: 1\n\nbody\n"
    back = df.select(A.parse_article(F.lit(text)).alias("a")).first()["a"]
    assert back.headers == {"A": "x\n\ty", "b": "1"} and back.body == "body\n"
    assert df.select(A.rnews_record(F.lit("é"))).first()[0] == "#! rnews 2\né"
    assert df.select(A.mbox_record(F.lit("x\nFrom y"), F.lit("a@b"), F.lit(0).cast("long"))).first()[0] == "From a@b Thu Jan 1 00:00:00 1970\nx\n>From y\n"


def test_exports_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, 20, 'a"b', None), (1, 10, "x", 1.5)], "id long, received_us long, name string, score double")
    A.export_jsonl(df, f"{tmp_path}/j")
    rows = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()]
    assert sorted(r["id"] for r in rows) == [1, 2] and list(rows[0]) == ["id", "name", "received_us", "score"] and None in [r["score"] for r in rows]
    A.export_csv(df, f"{tmp_path}/c")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/c").distinct().collect())
    assert lines == ['"1","x","10","1.5"', '"2","a""b","20",""', '"id","name","received_us","score"']
    events = df.withColumn("article_type", F.lit("text"))
    hits = spark.createDataFrame([(1, "r")], "event_id long, rule_id string")
    for _ in range(2):  # the same batch twice is recorded once
        A.write_events(events, hits, f"{tmp_path}/log", 7)
    got, got_hits = A.read_events(spark, f"{tmp_path}/log")
    assert got.count() == 2 and got_hits.count() == 1


def stream_of(spark, df, path, files=3):
    df.repartition(1).sortWithinPartitions("ts").write.parquet(f"{path}/0")
    return spark.readStream.schema(df.schema).parquet(f"{path}/*")


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_counters(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"u{r.randrange(4)}", i, r.randrange(200_000) * 1_000_000, r.randrange(50)) for i in range(200)]
    df = spark.createDataFrame(rows, "lookup string, id long, received_us long, total_size long").withColumn("ts", F.timestamp_micros("received_us"))
    got = {x.id: (x.long_count, x.short_count, x.long_bytes) for x in run(spark, scoring.trailing_counts(stream_of(spark, df, str(tmp_path))), "counters").collect()}
    keys = ["lookup"]
    want = df.select("id", rates.trailing(F.lit(1).cast("long"), keys, rates.LONG_US).alias("l"), rates.trailing(F.lit(1).cast("long"), keys, rates.SHORT_US).alias("s"), rates.trailing(F.col("total_size"), keys, rates.LONG_US).alias("b"))
    assert got == {x.id: (x.l, x.s, x.b) for x in want.collect()}


def test_stream_health(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"p{r.randrange(2)}", i, i * 60_000_000, r.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "provider string, id long, ts_us long, ok boolean").withColumn("ts", F.timestamp_micros("ts_us"))
    got = {(x.id, x.failures, x.suppressed) for x in run(spark, scoring.health_stream(stream_of(spark, df, str(tmp_path))), "health").collect()}
    assert got == {(x.id, x.failures, x.suppressed) for x in reputation.provider_health(df).collect()}


def test_stream_scoring(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 1_000_000, "text") for i in range(10)], "id long, received_us long, article_type string").withColumn("ts", F.timestamp_micros("received_us"))
    score = lambda b: (b.withColumn("legacy_code", (F.col("id") % 2).cast("int")), b.where("id % 2 = 1").select(F.col("id").alias("event_id")))
    q = scoring.score_stream(stream_of(spark, df, f"{tmp_path}/in"), score, f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    events, hits = A.read_events(spark, f"{tmp_path}/out")
    assert events.count() == 10 and hits.count() == 5
    assert run(spark, scoring.dedupe_lookups(stream_of(spark, spark.createDataFrame([("p", "k"), ("p", "k"), ("q", "k")], "provider string, key string").withColumn("ts", F.timestamp_seconds(F.lit(5))), f"{tmp_path}/d")), "deduped").count() == 2


def test_rate_and_multipost_streams(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice(["ID", "IP"]), f"u{r.randrange(3)}", i, r.randrange(3 * 86_400) * 1_000_000, r.choice(["accepted", "rejected", None]), r.choice(["pass", "reject"]), r.randrange(9), r.randrange(4), None, f"d{r.randrange(4)}") for i in range(150)]
    df = spark.createDataFrame(rows, "kind string, lookup string, id long, received_us long, nntp_result string, technical_verdict string, total_size long, group_count int, followup_count int, article_digest string").withColumn("ts", F.timestamp_micros("received_us"))
    got = run(spark, scoring.rate_stream(stream_of(spark, df, str(tmp_path / "a"))), "rates")
    want = rates.rate_snapshot(df).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = run(spark, scoring.multipost_stream(stream_of(spark, df, str(tmp_path / "b"))), "multi")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rates.multipost_count(df).select(*got.columns).collect()))


def log_of(spark, tmp_path):
    from artisieve.sources.commits import CommitLog

    return CommitLog(spark, f"file://{tmp_path}/log")


def test_a_batch_is_committed_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(1, 10, "text"), (2, 90_000_000_000, "binary")], "id long, received_us long, article_type string")
    hits = spark.createDataFrame([(1, "r")], "event_id long, rule_id string")
    saved = spark.createDataFrame([(2, "binary", 5, "x")], "event_id long, article_type string, created_us long, content string")
    path = f"file://{tmp_path}/log"
    assert A.record_batch(events, hits, path, "a", saved)
    broken = hits.withColumn("rule_id", F.raise_error(F.lit("killed")).cast("string"))  # after the events, before the saved rows
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            A.record_batch(events, broken, path, "b", saved)
    got = lambda: tuple(x.count() for x in (*A.read_events(spark, path), A.read_saved(spark, path)))
    assert got() == (2, 1, 1)
    assert A.record_batch(events, hits, path, "b", saved) and got() == (4, 2, 2)
    assert not A.record_batch(events, hits, path, "b", saved) and got() == (4, 2, 2)
    log = log_of(spark, tmp_path)
    assert len(log.vacuum(1 << 62)) == 2 + 2 and got() == (4, 2, 2)  # what the two killed runs left
    log.snapshot()
    assert [m["names"] for m in log.manifests()] == [["a", "b"]] and got() == (4, 2, 2)
    more = hits.withColumn("score", F.lit(1.0))
    assert A.record_batch(events, more, path, "c") and got() == (6, 3, 2)
    assert [r.score for r in A.read_events(spark, path)[1].collect() if r.score] == [1.0]
    log.snapshot()  # two schemas of hits: nothing is gathered, nothing is lost
    assert got() == (6, 3, 2) and log.names() == {"a", "b", "c"}
    assert {f.name for f in (tmp_path / "log/article_events").rglob("received_date=*")} == {"received_date=1970-01-01", "received_date=1970-01-02"}
    with pytest.raises(ValueError):
        log.commit("../x", {})
    assert log.read("other", "x int").count() == 0
    assert not log._write(log._manifest("a"), {}) and got() == (6, 3, 2)  # the slower of two writers


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    from artisieve.streaming import late

    r = random.Random(7)
    times = [[r.randrange(0, 100), None, 99], [150, r.randrange(0, 200), 59, 60, 300], [], [210, 209, 211, 500], [399, 400, 401, None]]
    rows = [[(1000 * b + i, t) for i, t in enumerate(batch)] for b, batch in enumerate(times)]
    (tmp_path / "in").mkdir()
    want_late, seen = set(), None
    for b, batch in enumerate(rows):
        if not batch:
            continue
        mark = None if seen is None else seen - 40
        want_late |= {i for i, t in batch if t is None or (mark is not None and t < mark)}
        seen = max([x for x in (seen, *(t for _, t in batch)) if x is not None])
    stream = lambda: spark.readStream.schema("id long, received_us long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{tmp_path}/in")
    for b, batch in enumerate(rows):  # a restart of the stream for each file
        (tmp_path / f"in/{b}.json").write_text("\n".join(json.dumps({"id": i, "received_us": t}) for i, t in batch))
        late.split_late(stream(), f"file://{tmp_path}/log", f"{tmp_path}/check", 40).trigger(availableNow=True).start().awaitTermination()
    log = log_of(spark, tmp_path)
    got_rows, got_late = [x.id for x in log.read("rows").collect()], [(x.id, x.watermark_us) for x in log.read("late").collect()]
    assert {i for i, _ in got_late} == want_late and len(want_late) >= 4
    assert sorted(got_rows + [i for i, _ in got_late]) == sorted(i for batch in rows for i, _ in batch)
    assert late.corrected(log).count() == sum(map(len, rows))


def test_a_broken_rule_update_keeps_the_last_good_one(spark, tmp_path):
    from artisieve.streaming.refresh import RuleBook

    source, now = tmp_path / "rules.json", [0.0]
    put = lambda *rules: source.write_text("\n".join(json.dumps({"id": i, "pattern": p, "match_type": "regex"}) for i, p in rules))
    schema = "id string, pattern string, match_type string"
    book = lambda: RuleBook(spark, f"file://{tmp_path}/log", lambda: spark.read.schema(schema).json(str(source)), 60, lambda: now[0])
    with pytest.raises(ValueError):
        book().current()  # no source at all
    put(("a", "x+"))
    first = book()
    assert first.current()[0] == 1
    put(("a", "x+"), ("b", "y"))
    assert first.current()[0] == 1  # not looked again yet
    now[0] = 61
    version, rules_ = first.current()
    assert version == 2 and rules_.count() == 2
    for bad in ([("a", "(")], [("a", "x"), ("a", "y")], [(None, "x")]):
        put(*bad)
        assert first.refresh() and first.current()[0] == 2 and first.current()[1].count() == 2
    assert book().current()[0] == 2  # another process, same broken source
    put(("b", "y"), ("a", "x+"))
    assert not first.refresh() and first.current()[0] == 2  # equal rules are no new version
    put(("c", "z"))
    assert not first.refresh() and [r.id for r in first.current()[1].collect()] == ["c"]
    assert {r.fault.split(":")[0] for r in log_of(spark, tmp_path).read("refused").collect()} >= {"a", "None"}


def test_reports_are_refreshed_by_a_timer(spark, tmp_path):
    from artisieve.streaming.refresh import latest_report, refresh_report

    events = lambda: A.read_events(spark, f"file://{tmp_path}/events")[0]
    add = lambda n: A.write_events(spark.createDataFrame([(n, n, "text")], "id long, received_us long, article_type string"), spark.createDataFrame([], "event_id long"), f"file://{tmp_path}/events", n)
    add(1)
    schema = "id long, received_us long"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/events/article_events")
    query = refresh_report(stream, lambda s: events().agg(F.count("*").alias("n")), f"file://{tmp_path}/report", f"{tmp_path}/check", "1 second").start()
    try:
        query.processAllAvailable()
        assert latest_report(spark, f"file://{tmp_path}/report").first().n == 1
        add(2)
        query.processAllAvailable()
        assert latest_report(spark, f"file://{tmp_path}/report").first().n == 2
    finally:
        query.stop()


def test_message_files_round_trip(spark, tmp_path):
    from artisieve.sources import messages

    rows = [(i, 1_700_000_000_000_000 + i, f"<m{i}@x>", {"Subject": f"s {i}", "From": "a@b.c"}, "body é\n\nmore" if i % 3 else None) for i in range(40)]
    a = spark.createDataFrame(rows, "article_id long, received_us long, message_id string, headers map<string,string>, body string").repartition(3)
    path = f"file://{tmp_path}/out"
    messages.write_message_files(A.file_records(a), path)
    got = messages.read_message_files(spark, path)
    assert sorted((r.headers["Subject"], r.headers["From"], r.body) for r in got.collect()) == sorted((r[3]["Subject"], "a@b.c", r[4] or "") for r in rows)
    assert sorted(r.body for r in A.read_articles(spark, f"{path}/*").collect()) == sorted(r[4] or "" for r in rows)
    bad = A.file_records(a).withColumn("file_name", F.when(F.col("file_name").contains("000039"), "../x").otherwise(F.col("file_name")))
    with pytest.raises(Exception, match="not a file's name"):
        messages.write_message_files(bad, path)
    assert got.count() == 40 and len(list((tmp_path / "out").iterdir())) == 1  # an abort leaves nothing
    messages.write_message_files(A.file_records(a.limit(0)), path)
    messages.write_message_files(A.file_records(a.limit(5)), path)
    assert messages.read_message_files(spark, path).count() == 45
    assert messages.read_message_files(spark, f"file://{tmp_path}/none").count() == 0


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path):
    from artisieve.sources import messages

    writer = messages.FileWriter({"path": f"file://{tmp_path}/out"}, False)

    def rows():
        yield {"file_name": "a", "content": "X: 1"}
        writer.abort([])
        yield {"file_name": "b", "content": "X: 2"}

    for late in (rows(), iter([{"file_name": "c", "content": "X: 3"}])):  # one under way, one that only begins
        with pytest.raises(FileNotFoundError):
            writer.write(late)
    assert list((tmp_path / "out").iterdir()) == []


def test_empty_article_files_are_articles_in_batch_and_stream(spark, tmp_path):
    from artisieve.sources import messages

    (tmp_path / "in/deep").mkdir(parents=True)
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    put("a.post", "From: a@b.c\n\nbody")
    put("deep/empty.post", "")
    put("_hidden", "From: x\n\n")
    got = {r.file.rsplit("/", 1)[1]: (r.headers, r.body, r.size) for r in messages.read_message_files(spark, f"{tmp_path}/in").collect()}
    assert got == {"a.post": ({"From": "a@b.c"}, "body", 17), "empty.post": ({}, "", 0)}
    assert len(messages.shares(messages.listed(f"{tmp_path}/in"), 4096)) == 2

    def step():
        q = messages.stream_message_files(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").start(f"{tmp_path}/seen")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.file.rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/seen").collect())

    assert step() == ["a.post", "empty.post"]
    put("b.post", "")
    put("c.post", "X: 1\n\n")
    assert step() == ["a.post", "b.post", "c.post", "empty.post"]
    assert step() == ["a.post", "b.post", "c.post", "empty.post"]  # nothing is read twice


def in_files(spark, rows, schema, path, each):
    """A stream that meets ``each`` rows a batch, in order."""
    path.mkdir()
    for i in range(0, len(rows), each):
        spark.createDataFrame(rows[i : i + each], schema).coalesce(1).write.json(f"{path}/w{i:05d}")
    for i, f in enumerate(sorted(path.glob("w*/part-*.json"))):
        f.rename(path / f"{i:05d}.json")
        os.utime(path / f"{i:05d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/*.json")


def run_until(spark, stream, name, rows, seconds=90):
    """The first ``rows`` rows of a stream that goes on by itself, as one with timeouts does."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        end = time.monotonic() + seconds
        while spark.table(name).count() < rows and time.monotonic() < end and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    return spark.table(name)


def test_thread_marks_follow_replies_across_batches(spark, tmp_path):
    from artisieve.operators.threads import local_threads
    from artisieve.streaming.marks import thread_stream

    r = random.Random(3)
    posts = []
    for t in range(4):
        ids = []
        for k in range(30):
            parent = r.choice([None, f"m{t}-{k}", "gone", *ids[-4:]]) if k else None
            posts.append((f"t{t}", f"m{t}-{k}", parent, r.choice(["", "", "", None, " Local ", "usenet", "world"]) if k else "local", r.random() < 0.85, 10 * k))
            ids.append(f"m{t}-{k}")
    posts.sort(key=lambda p: (p[5], p[1]))
    schema = "root string, message_id string, parent_id string, distribution string, accepted boolean, ord long"
    got = run_until(spark, thread_stream(in_files(spark, posts, schema, tmp_path / "in", 17)), "marks", len(posts))
    want = local_threads(spark.createDataFrame(posts, schema)).select("message_id", F.coalesce("local", F.lit(False)).alias("local"), "legacy_code")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(x.local for x in got.collect()) > 20


def test_lookup_cache_equals_the_batch_result(spark, tmp_path):
    from artisieve.streaming.marks import lookup_stream

    r = random.Random(6)
    rows = sorted(((r.choice("pq"), f"k{r.randrange(4)}", r.randrange(4_000) * 1_000_000, i, r.random() < 0.4) for i in range(150)), key=lambda x: (x[2], x[3]))
    schema = "provider string, key string, ts_us long, id long, listed boolean"
    got = run_until(spark, lookup_stream(in_files(spark, rows, schema, tmp_path / "in", 25), 200_000_000, 40_000_000), "cache", len(rows))
    want = reputation.lookup_dedupe(spark.createDataFrame(rows, schema), 200_000_000, 40_000_000).select("id", "cached")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 20 < got.where("cached").count() < 140
