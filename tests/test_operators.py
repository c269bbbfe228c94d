"""Operators on small literal inputs: rules, structure, validity, MIME, identity, addresses, decisions."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress

import pytest
from pyspark.sql import functions as F

from artisieve.functions import codes
from artisieve.functions import text as X
from artisieve.operators import content, decide, features, history, privacy, rates, reputation, rules, structure, threads, validity


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_codes(spark):
    assert len(codes.MESSAGES) == 119 and sorted(codes.MESSAGES) == list(range(119))
    assert [codes.symbol(c) for c in (0, 17, 34, 57, 95, 104, 105, 108, 112, 118, 500)] == ["PF-INTERNAL-000", "PF-GROUP-017", "PF-RULE-034", "PF-BODY-057", "PF-GROUP-095", "PF-HEADER-104", "PF-AUTH-105", "PF-GROUP-108", "PF-BODY-112", "PF-RFC-118", "PF-INTERNAL-500"]
    asked = spark.createDataFrame([("34",), ("PF-RULE-034",), ("PF-BODY-034",), ("x",)], "query string")
    assert {r["query"]: r.legacy_code for r in codes.resolve(asked).collect()} == {"34": 34, "PF-RULE-034": 34, "PF-BODY-034": None, "x": None}


@pytest.mark.parametrize(("value", "want"), [("A <A@B.c>", "a@b.c"), ("x@y.z (me)", "x@y.z"), ("none", ""), (None, "")])
def test_email(spark, value, want):
    assert one(spark, X.normalize_email(F.col("v")), v=value) == want


@pytest.mark.parametrize(("groups", "want"), [("a.b", "text"), ("alt.binaries.x", "binary"), ("a.b, alt.binaries.x", "mixed"), ("ALT.BINARIES.y,", "binary"), ("", "text"), (None, "text")])
def test_article_type(spark, groups, want):
    assert one(spark, X.article_type(X.split_groups(F.col("g")), ["alt.binaries.*", "x.?"]), g=groups) == want


def test_networks(spark):
    nets = ["10.0.0.0/8", "10.1.2.3", "0.0.0.0/0", "192.0.2.128/25", "::/0", "2001:db8::/33", "fe80::1", "bad/8", "1.2.3.4/40"]
    ips = ["10.1.2.3", "192.0.2.200", "192.0.2.5", "2001:db8:7fff::1", "2001:db8:8000::", "fe80::1", "::", "300.1.1.1", "x", None]
    got = {(r.ip, r.network) for r in rules.cidr_matches(spark.createDataFrame([(i,) for i in ips], "client_ip string"), spark.createDataFrame([(n,) for n in nets], "network string")).collect()}
    want = set()
    for i in ips:
        for n in nets:
            try:
                a, b = ipaddress.ip_address(i), ipaddress.ip_network(n)
            except ValueError:
                continue
            if a.version == b.version and a in b:
                want.add((i, n))
    assert got == want
    assert one(spark, X.reverse_ip(F.col("v")), v="192.0.2.9") == "9.2.0.192"
    assert one(spark, X.reverse_ip(F.col("v")), v="2001:db8::1") == ".".join(reversed("20010db8000000000000000000000001"))


def test_registered_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ["a.b.co.uk", "co.uk", "x.y.zz", "localhost", "1.2.3.4", "www.example.com", "::1", None, ""]], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    got = {r.host: r.domain for r in features.registered_domains(hosts, suffixes).collect()}
    assert got == {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.y.zz": "y.zz", "localhost": "localhost", "1.2.3.4": "1.2.3.4", "www.example.com": "example.com", "::1": "::1"}


def test_lines_and_urls(spark):
    s = one(spark, X.line_statistics(F.col("b")), b="> q\r\n\n  \nlong line\n")
    assert (s.lines, s.quoted, s.empty, s.blank, s.longest) == (5, 1, 2, 1, 9)
    assert one(spark, X.urls(F.col("b")), b="see http://A.example/x, (HTTP://b.example/y). http://A.example/x!") == ["http://A.example/x", "HTTP://b.example/y"]
    assert [one(spark, X.url_host(F.lit(u))) for u in ("http://u:p@H.example:80/x", "https://[::1]:8080/", "ftp://x")] == ["h.example", "::1", ""]


def event(i, t, user="u1", result="accepted", verdict="pass", size=10, kind="text", digest="d"):
    return (i, t, user, "198.51.100.1", kind, verdict, result, size, 2, 1, digest)


EVENTS = "id long, received_us long, auth_user string, client_ip string, article_type string, technical_verdict string, nntp_result string, total_size long, group_count int, followup_count int, article_digest string"


def test_rates(spark):
    second = 1_000_000
    rows = [event(1, 0), event(2, 100 * second), event(3, 100 * second, kind="binary"), event(4, 700 * second, result="rejected", verdict="reject"), event(5, 86_400 * second), event(6, 86_401 * second), event(7, 5, user=None), event(8, 6, user="")]
    df = spark.createDataFrame(rows, EVENTS)
    by_id = {r.id: r for r in rates.rate_snapshot(rates.identities(df)).collect()}
    assert [by_id[i].max_articles for i in (1, 2, 3, 4, 5, 6)] == [0, 1, 2, 3, 3, 3]  # the long period's lower bound is closed
    assert (by_id[4].max_short_articles, by_id[3].max_short_articles) == (2, 2)
    assert (by_id[6].max_total_errors, by_id[5].max_total_size, by_id[4].max_total_groups, by_id[6].max_total_followups) == (1, 40, 6, 4)
    assert (by_id[7].kind, by_id[8].kind, by_id[8].max_articles) == ("IP", "IP", 1)
    typed = {r.id: r.max_articles for r in rates.rate_snapshot(rates.identities(df), by_type=True).collect()}
    assert typed[3] == 0 and typed[4] == 2
    assert {r.id: r.multipost for r in rates.multipost_count(df).collect()}[6] == 3
    snap = rates.rate_snapshot(rates.identities(rates.multipost_count(df)))
    found = {r.id: (r.legacy_code, r.metric) for r in rates.rate_violations(snap, {"ID": {"max_articles": 2, "multipost": 0}, "IP": {"max_total_size": 15, "multipost": 0}}).collect()}
    assert found == {3: (33, "max_articles"), 4: (33, "max_articles"), 5: (33, "max_articles"), 6: (33, "max_articles"), 8: (76, "max_total_size")}
    assert rates.rate_violations(snap, {}, default_multipost=1).where("legacy_code = 30").count() == 7
    assert rates.rate_snapshot(rates.identities(df.limit(0))).count() == 0


def test_enforced_rates_equal_a_replay(spark):
    import random

    r = random.Random(5)
    minute = 60_000_000
    rows = [event(i, i * 37 * minute + r.randrange(30) * minute, user=f"u{r.randrange(3)}", verdict="reject" if r.random() < 0.15 else "pass", size=r.randrange(9)) for i in range(150)]
    limits = {"ID": {"max_articles": 6, "max_short_articles": 2, "max_total_errors": 7, "multipost": 0}}
    past, want = [], {}
    for e in sorted(rows, key=lambda e: (e[1], e[0])):
        mine = [p for p in past if p[1] == e[2] and p[0] >= e[1] - rates.LONG_US]
        articles_ = sum(p[2] for p in mine)
        short = sum(p[2] for p in mine if p[0] >= e[1] - rates.SHORT_US)
        errors = sum(not p[2] for p in mine)
        code = 33 if articles_ + 1 > 6 else 72 if short + 1 > 2 else 66 if errors > 7 else 0
        if e[5] == "pass" and code:
            want[e[0]] = code
        past.append((e[1], e[2], e[5] == "pass" and not code))
    got = {x.id: x.legacy_code for x in rates.enforce_outcomes(spark.createDataFrame(rows, EVENTS), limits).collect()}
    assert got == want and len(want) > 10


def replay(rows, limits, absolute=0, default=2):
    """Event by event, over lists."""
    index = {"articles": 0, "errors": 1, "size": 2, "groups": 3, "followups": 4}
    past, digests, out = {}, {}, {}
    for e in sorted(rows, key=lambda e: (e[1], e[0])):
        now, bad = e[1], e[5] == "reject"
        who = [("ID", e[2])] if e[2] else [(k, v) for k, v in (("IP", e[3]), ("DN", e[11])) if v]
        seen = sum(a for t, a in digests.get(e[10], []) if t >= now - rates.LONG_US)
        own = (1, 0, e[7], e[8], e[9])
        code = 30 if who and 0 < absolute <= seen else 0
        for kind, name in who:
            if code:
                break
            if 0 < limits.get(kind, {}).get("multipost", default) <= seen:
                code = 30
            for metric, codes in rates.METRICS:
                since = now - (rates.SHORT_US if "short" in metric else rates.LONG_US)
                v = index[metric.rsplit("_", 1)[1]]
                limit = limits.get(kind, {}).get(metric)
                if not code and limit is not None and own[v] is not None and sum(x[v] for t, x in past.get((kind, name), []) if t >= since) + own[v] > limit:
                    code = codes[kind]
        if not bad and code:
            out[e[0]] = code
        accepted = not bad and not code
        for key in who:
            past.setdefault(key, []).append((now, (accepted, not accepted, e[7] or 0, e[8] or 0, e[9] or 0)))
        digests.setdefault(e[10], []).append((now, accepted))
    return out


@pytest.mark.parametrize("absolute", [0, 4])
def test_enforcement_joins_identities_and_digests(spark, absolute):
    import random

    r = random.Random(8)
    rows = []
    for i in range(500):
        t = (r.randrange(4) * 3 * 86_400 + r.randrange(100_000)) * 1_000_000 // 60_000_000 * 60_000_000  # rests of days, ties of minutes
        rows.append((i, t, r.choice([None, "", "u1", "u2", f"u{r.randrange(40)}"]), r.choice([None, "192.0.2.1", f"192.0.2.{r.randrange(9)}"]), "text", r.choice(["reject", "pass", "pass", None]), "accepted", r.choice([None, 5, 50]), r.choice([None, 1, 3]), 1, f"d{r.randrange(60)}", r.choice([None, "a.example", "b.example"])))
    limits = {"ID": {"max_articles": 6, "max_short_articles": 3, "max_total_errors": 9, "max_total_groups": 30}, "IP": {"max_articles": 8, "max_short_size": 90, "multipost": 5}, "DN": {"max_total_followups": 12, "multipost": 0}}
    df = spark.createDataFrame(rows, EVENTS + ", client_domain string").repartition(3)
    got = {x.id: x.legacy_code for x in rates.enforce_outcomes(df, limits, absolute_multipost=absolute, domain_check=True).collect()}
    want = replay(rows, limits, absolute)
    assert got == want and {30, 31, 33} <= set(want.values())
    assert rates.enforce_outcomes(df.limit(0), limits).count() == 0


def test_a_busy_identity_settles_in_one_pass(spark):
    df = spark.range(100_000).select("id", (F.col("id") * 7_000_000).alias("received_us"), F.lit("u1").alias("auth_user"), F.lit("192.0.2.1").alias("client_ip"), F.lit("text").alias("article_type"), F.lit("pass").alias("technical_verdict"), F.lit(1).cast("long").alias("total_size"), F.lit(1).alias("group_count"), F.lit(0).alias("followup_count"), F.col("id").cast("string").alias("article_digest"))
    got = rates.enforce_outcomes(df, {"ID": {"max_short_articles": 10}}).agg(F.count("*"), F.min("id")).first()
    # Ten in ten minutes: 86 events fit the window, ten of them are accepted.
    assert got[1] == 10 and 0.87 < got[0] / 100_000 < 0.9


def test_counters_of_a_hot_key_are_spread_over_its_buckets(spark):
    import random

    r = random.Random(9)
    rows = [event(i, r.randrange(-86_400, 4 * 86_400) * 1_000_000, user="hot" if i % 3 == 0 else f"u{i % 7}", size=r.choice([None, 1, 5]), result=r.choice(["accepted", "rejected"])) for i in range(900)]
    rows += [event(1000 + i, 86_400_000_000, user="hot") for i in range(20)]  # ties, on a bucket's edge
    df = rates.identities(spark.createDataFrame(rows, EVENTS)).repartition(4)
    keys = ["kind", "lookup"]
    accepted = F.when(F.col("nntp_result") == "accepted", 1).otherwise(0).cast("long")
    for long_us, short_us in ((rates.LONG_US, rates.SHORT_US), (70_000_000, 21_000_000), (rates.LONG_US, rates.LONG_US)):
        plain = df.withColumns({"a": rates.trailing(accepted, keys, long_us), "b": rates.trailing(F.col("total_size"), keys, short_us)})
        snap = rates.rate_snapshot(df, long_us=long_us, short_us=short_us)
        assert {x.id: (x.max_articles, x.max_short_size) for x in snap.collect()} == {x.id: (x.a, x.b) for x in plain.collect()}
    plan = rates.rate_snapshot(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan.split("Window", 2)[1].split("\n")[0] and rates.rate_snapshot(df).columns[: len(df.columns)] == df.columns


def test_networks_join_on_prefixes(spark):
    import random

    r = random.Random(3)
    groups = lambda: f"2001:db8:{r.randrange(4):x}:{r.randrange(65536):x}::{r.randrange(9):x}"
    ips = [groups() for _ in range(150)] + [f"10.{r.randrange(4)}.{r.randrange(256)}.{r.randrange(256)}" for _ in range(150)] + [None, "", "x", "10.0.0", "::", "::1", "1::2::3", "FE80::A"]
    nets = [f"2001:db8:{r.randrange(4):x}:{r.randrange(65536):x}::/{r.randrange(20, 128)}" for _ in range(300)] + [f"10.{r.randrange(4)}.{r.randrange(256)}.0/{r.randrange(0, 33)}" for _ in range(300)]
    nets += ["10.1.2.3", "::1", "fe80::/10", "0.0.0.0/0", "::/0", "bad", "10.0.0.0/33", "::/129", None, "10.1.2.3"]
    read = {n: ipaddress.ip_network(n, strict=False) for n in nets if n not in (None, "bad", "10.0.0.0/33", "::/129")}
    want = set()
    for i in ips:
        try:
            a = ipaddress.ip_address(i or "x")
        except ValueError:
            continue
        want |= {(i, n) for n, net in read.items() if a.version == net.version and a in net}
    addresses, networks = spark.createDataFrame([(i,) for i in [*ips, *ips]], "client_ip string"), spark.createDataFrame([(n,) for n in nets], "network string")
    found = rules.cidr_matches(addresses, networks)
    got = list(map(tuple, found.collect()))
    assert set(got) == want and len(got) == len(want) > 500
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    best = {x.ip: (x.network, x.bits) for x in rules.longest_prefix(addresses, networks).collect()}
    assert best == {i: min(((n, read[n].prefixlen) for j, n in want if j == i), key=lambda t: (-t[1], t[0])) for i in {i for i, _ in want}}
    assert rules.cidr_matches(addresses, networks.limit(0)).count() == 0


def test_provider_health_over_buckets(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice(["a", "a", "b", None]), r.randrange(40) * 9_000_000, i, r.random() < 0.25) for i in range(400)]
    state, want = {}, {}
    for p, t, i, ok in sorted(rows, key=lambda e: (e[1], e[2])):
        failures, struck = state.get(p, (0, None))
        suppressed = struck is not None and t - struck < 50_000_000
        failures = 0 if ok else failures + 1
        state[p] = failures, t if failures >= 3 else struck
        want[i] = (failures, suppressed)
    log = spark.createDataFrame(rows, "provider string, ts_us long, id long, ok boolean")
    for bucket in (7_000_000, 100_000_000, 10**12):
        got = {x.id: (x.failures, x.suppressed) for x in reputation.provider_health(log, 3, 50_000_000, bucket).collect()}
        assert got == want


@pytest.mark.parametrize(
    ("pattern", "want"),
    [(r"\bder\b", ["der"]), ("foo|barbaz", ["barbaz", "foo"]), ("colou?r", ["colo"]), ("ab*cde", ["cde"]), (r"(?:foo|bar)+x", ["bar", "foo"]), ("a|", None), ("(?x) a b", None), (r"\Qa.b\E", None), ("(?!hello)abc", ["abc"]), ("(?=hello)x", None), ("(hello)?xy", ["xy"]), ("hel{0}lo", ["he"]), ("[x-z]ab[]]", ["ab"]), ("(", None), ("слово hello", [" hello"]), ("", None), ("[[a]b]cc", None), (r"\x41bc", None)],
)
def test_required_strings(pattern, want):
    from artisieve.operators.automaton import needles

    assert needles(pattern, "regex") == want


def test_twenty_thousand_rules_equal_the_plain_join(spark, monkeypatch):
    import random

    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzkKsSiI"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 5)))
    kinds = [lambda: (word(), "contains"), lambda: (rf"\b{word()}\b", "regex"), lambda: (f"{word()}|{word()}", "regex"), lambda: (f"{word()}[aeiou]?{word()}", "regex"), lambda: (word(), "exact"), lambda: (f"(?:{word()}|{word()})+", "regex"), lambda: (f"ſ{word()}é", "contains")]
    table = [(f"r{i}", i, r.randrange(9), r.choice(["body", "subject", "header.X-A", "from.address", "newsgroups"]), *r.choice(kinds)(), r.choice([True, False, None]), "log") for i in range(20_000)]
    table += [("net", 1, 50, "client.ip", "192.0.2.0/28", "cidr", False, "log"), ("short", 2, 50, "body", "q", "contains", False, "log"), ("none", 3, 50, "body", None, "contains", False, "log"), ("bad", 4, 50, "body", "(?x) a  # b", "regex", False, "log")]
    rows = [(i, " ".join(word() for _ in range(6)), r.choice([None, " ".join(r.choice([word(), "\u212a" + word(), "\u017f" + word(), "\u0130" + word()]) for _ in range(200))]), word(), f"{word()}@x.y", f"192.0.2.{i}", "text", {"X-A": word()}) for i in range(24)]
    a = spark.createDataFrame(rows, "article_id long, subject string, body string, newsgroups string, from string, client_ip string, article_type string, headers map<string,string>")
    rules_ = spark.createDataFrame(table, "id string, ord int, priority int, target string, pattern string, match_type string, case_sensitive boolean, action string")
    got = {(x.article_id, x.rule_id) for x in rules.ban_hits(a, rules_, cap=30_000, scan=None).select("article_id", "rule_id").collect()}
    plan = rules.ban_hits(a, rules_, cap=30_000, scan=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "NestedLoop" not in plan
    monkeypatch.setattr(rules, "tried", lambda articles, rules_, test, reads, texts: rules.met_rules(articles, rules_, test))
    want = {(x.article_id, x.rule_id) for x in rules.ban_hits(a, rules_, cap=30_000, scan=None).select("article_id", "rule_id").collect()}
    assert got == want and len(want) > 2000


def test_plain_words_are_decided_where_they_are_found(spark, monkeypatch):
    import random

    from artisieve.operators import automaton

    assert automaton.plain("(^|[^a-z])Word([^a-z]|$)", "regex") == ("word", automaton.WORD) and automaton.plain("ab", "regex") == ("ab", automaton.HELD)
    assert automaton.plain("a b", "contains") == ("a b", automaton.LOWER) and automaton.plain("a.b", "regex") is None and automaton.plain("é1", "contains") is None
    r = random.Random(5)
    word = lambda: "".join(r.choice("aikSs") for _ in range(r.randint(2, 4)))
    shapes = [lambda w: (w, "contains"), lambda w: (w, "regex"), lambda w: (f"(^|[^a-z]){w}([^a-z]|$)", "regex"), lambda w: (f"{w}+", "regex"), lambda w: (w, "exact")]
    table = spark.createDataFrame([(f"r{i}", i, *r.choice(shapes)(word()), r.choice([True, False, None]), r.choice([None, ["body"], ["subject"]]), "score") for i in range(900)], "id string, ord int, pattern string, match_type string, case_sensitive boolean, targets array<string>, action string")
    text = lambda n: r.choice(["", "\n"]).join(r.choice(["ſ", "ı", "İ", "\u212a", " ", "\n", "é", "1", word(), word()]) for _ in range(n))
    a = articles(spark, *((text(3), text(40), "a.b", "x", None, "text") for _ in range(40)), (None, "ai", "a.b", "x", None, "text"), ("si\n", None, "a.b", "x", None, "text"))
    hits = lambda t: {tuple(x) for x in content.badword_hits(a, t, scan=None).select("article_id", "rank", "rule_id", "subject_hit", "body_hit").collect()}
    cut = table.withColumn("stop_on_match", F.col("ord") % 50 == 49)
    got, got_cut = hits(table), hits(cut)
    assert automaton.indexed([(1, False, [("body", "ai", "contains")])])[0] == {"body": {"ai": [(1, automaton.LOWER)]}}
    monkeypatch.setattr(content, "tried", lambda articles, rules_, test, reads, texts: rules.met_rules(articles, rules_, test))
    assert got == hits(table) and got_cut == hits(cut) and len(got) > len(got_cut) > 40


def test_scan_limits_are_bytes(spark):
    a = articles(spark, ("s", "éééé日word", "a.b", "x", None, "text"), ("s", "word éé", "a.b", "x", None, "binary"), ("s", None, "a.b", "x", None, "text"))
    got = [r.body for r in rules.scan_body(a, {"text": 9, "binary": 6}).orderBy("article_id").collect()]
    assert got == ["éééé", "word ", None]
    assert [r.body for r in rules.scan_body(a, {"text": 15, "binary": 0}).orderBy("article_id").collect()] == ["éééé日word", "word éé", None]


def test_dates_are_read_without_case_and_xref_whole(spark):
    for value in ("mon, 01 jan 2024 00:00:00 +0000", "MON, 1 JAN 2024 00:00 GMT", "1 Jan 2024 00:00:00 -0100"):
        assert validity.is_date(value)
    assert not validity.is_date("Mxn, 1 Jan 2024 00:00:00 +0000") and not validity.is_date("1 Jam 2024 00:00:00 +0000")
    long = "news.example " + " ".join(f"a.b:{i}" for i in range(12_000))
    rows = spark.createDataFrame([("Xref", long), ("Xref", long + " bad")], "name string, value string")
    assert [r[0] for r in rows.select(validity.native_reason(F.col("name"), F.col("value"))).collect()] == [None, "invalid-xref"]


def articles(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "article_id long, subject string, body string, newsgroups string, from string, client_ip string, article_type string")


def test_badwords(spark):
    a = articles(spark, ("Buy now", "cheap CHEAP", "a.b", "x@y.z", "192.0.2.1", "text"), ("ok", None, "a.b", "x@y.z", None, "binary"), ("привет Слово", "", "a.b", "x", None, "text"))
    words = spark.createDataFrame([("a", 1, "buy", "contains", ["subject"], 1.0, 0.0, "score", None, None), ("b", 2, "cheap", "regex", ["body"], 0.0, 2.0, "reject", None, None), ("c", 3, "now", "contains", None, 5.0, 5.0, "score", None, None), ("d", 4, "слово", "regex", None, 1.0, 1.0, "score", ["text"], None), ("e", 5, "ok", "exact", None, 1.0, 1.0, "score", ["text"], None), ("f", 6, "ok", "exact", None, 1.0, 1.0, "score", [], False)], "id string, ord int, pattern string, match_type string, targets array<string>, subject_score double, body_score double, action string, article_types array<string>, enabled boolean")
    hits = content.badword_hits(a, words)
    assert sorted((r.article_id, r.rule_id) for r in hits.collect()) == [(0, "a"), (0, "b"), (2, "d")]
    got = {r.article_id: (r.subject_score, r.body_score, r.legacy_code) for r in content.badword_verdict(hits).collect()}
    assert got == {0: (1.0, 2.0, 29), 2: (1.0, 0.0, 28)}


def test_bans_scores_and_overrides(spark):
    a = articles(spark, ("s", "body", "a.b,c.d", "X <x@y.z>", "192.0.2.1", "text"), ("t", "b", "c.d", "q@r.s", "2001:db8::5", "text")).withColumn("headers", F.create_map(F.lit("X-B"), F.lit("spam here"), F.lit("X-A"), F.lit("spam")))
    schema = "id string, ord int, priority int, target string, match_type string, pattern string, action string, header_name_pattern string, header_value_pattern string, exclude_groups string"
    table = spark.createDataFrame([("r1", 1, 1, "from.address", "exact", "X@Y.z", "reject", None, None, None), ("r2", 2, 9, "any.header", None, None, "log", "^x-", "spam", None), ("r3", 3, 5, "client.ip", "cidr", "2001:db8::/32", "drop", None, None, None), ("r4", 4, 0, "body", "regex", "b", "log", None, None, None), ("r5", 5, 9, "header.X-A", "contains", "SPAM", "save", None, None, r"a\.b")], schema)
    hits = rules.ban_hits(a, table)
    assert sorted((r.article_id, r.rule_id, r.header_name) for r in hits.collect()) == [(0, "r1", None), (0, "r2", "X-A"), (1, "r2", "X-A"), (1, "r3", None), (1, "r5", None)]
    got = {r.article_id: (r.legacy_code, r.requested_action, r.rule_id, r.force_save) for r in rules.ban_verdict(hits).collect()}
    assert got == {0: (34, None, "r1", False), 1: (34, "discard", "r3", True)}
    steps = spark.createDataFrame([(0, 1, "add_score", "a", "4", None), (0, 2, "clear_score", "a", None, None), (0, 3, "add_score", "a", None, 2.0), (0, 4, "add_score", None, None, None), (1, 1, "set_score_limit", "b", "3", None), (1, 2, "add_score", "b", "4", None), (1, 3, "verify_score", "b", None, None), (1, 4, "clear_score", "b", None, None), (2, 1, "add_score", "z", "11", None), (2, 2, "set_config", "limits.x", "5", None), (2, 3, "set_config", "limits.x", "6", None)], "article_id long, rank int, action string, score_name string, value string, score double")
    got = {r.article_id: (r.scores, r.over) for r in rules.named_scores(steps).collect()}
    assert got[0] == ({"a": 2.0, "default": 1.0}, None) and got[1] == ({"b": 0.0}, "b") and got[2][1] == "z"
    assert [r.overrides for r in rules.config_overrides(steps).collect()] == [{"limits.x": "6"}]


def test_registered_scores_read_whole_bodies(spark, tmp_path):
    from artisieve.plans import queries

    far = "x" * 40_000 + " quelle"  # beyond the bytes that other rules read
    docs = [(1, "a\n" + far, "en", "src"), (2, "the\n" + far, "de", "src"), (3, "a\nb", "de", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.named_scores(spark, str(tmp_path)).collect())
    assert got == [(1, 11.5, 0.0, "lang"), (2, 7.5, 3.0, None)]


def test_bad_patterns_are_disabled(spark):
    table = spark.createDataFrame([("ok", "a+", "regex"), ("bad", "(", "regex"), ("text", "(", "contains")], "id string, pattern string, match_type string")
    assert {r.id: r.enabled for r in rules.valid_rules(table).collect()} == {"ok": True, "bad": False, "text": True}


BASE = {"From": "A <a@b.example>", "Newsgroups": "local.test", "Subject": "s", "Message-ID": "<a@b.example>", "Date": "Mon, 1 Jan 2024 10:00:00 +0000"}
BAD = [
    ("Message-ID", "<a@b", "invalid-message-id"), ("Newsgroups", "a,,b", "invalid-newsgroups"), ("Newsgroups", "a b", "invalid-newsgroups"), ("Followup-To", "poster, a.b", "invalid-followup-to"),
    ("Distribution", "world, all", "invalid-distribution"), ("Date", "Mon, 32 Jan 2024 10:00:00 +0000", "invalid-date-time"), ("Expires", "soon", "invalid-date-time"), ("Injection-Date", "1 Jan 2024 24:00:00 GMT", "invalid-date-time"),
    ("References", "<a@b> x", "invalid-references"), ("Supersedes", "x", "invalid-supersedes"), ("Control", "new\u0001", "invalid-control"), ("Archive", "maybe", "invalid-archive"), ("Archive", "yes; x", "invalid-archive"),
    ("Injection-Info", "a.example; foo=1", "invalid-injection-info"), ("Injection-Info", "a.example;", "invalid-injection-info"), ("Injection-Info", "a.example; posting-host=a; posting-host=b", "invalid-injection-info"),
    ("MIME-Version", "1.1", "invalid-mime-version"), ("User-Agent", "a//b", "invalid-user-agent"), ("Content-Language", "en_US", "invalid-content-language"), ("Content-Transfer-Encoding", "9bit", "invalid-content-transfer-encoding"),
    ("From", "a@b@c", "invalid-mailbox-list"), ("From", '"x <a@b.c>', "invalid-mailbox-list"), ("Sender", "a@b.c, d@e.f", "invalid-mailbox"), ("Content-Type", "text", "invalid-content-type"), ("Content-Type", "text/plain; a=1; A=2", "invalid-content-type"),
    ("Content-Disposition", "a/b", "invalid-content-disposition"), ("Xref", "server", "invalid-xref"), ("Lines", "x1", "invalid-lines"), ("Path", "a b!c", "invalid-path"), ("Path", "a.b!c.d", "invalid-path"),
]
GOOD = {
    "Followup-To": "Poster", "Distribution": "world, local", "Expires": "(c (d)) 1 Jan 2024 10:00 GMT", "References": "<a@b.c> (note (nested)) <d@[1.2.3.4]>", "Control": "newgroup a.b", "Archive": 'no; filename="a;b"',
    "Injection-Info": 'news.example.org; posting-host="a\\"b"; x-more=1', "MIME-Version": "1.0 (x)", "User-Agent": "a/1.0 (x; y) b", "Content-Language": "en, de-AT, *", "Content-Transfer-Encoding": "X-foo",
    "Sender": '"a, b" <c@d.example>', "Content-Type": 'text/plain; charset="utf-8"; format=flowed', "Content-Disposition": "inline", "Xref": "server.example a.b:12 c.d:5", "Lines": " 12 ", "Path": "a.example!!b.example!.POSTED.x!c.example!1.2.3.4!not-for-mail", "Summary": "x",
}


def violations(spark, *heads, bodies=None, **options):
    rows = [(i, h, (bodies or {}).get(i, "text\n")) for i, h in enumerate(heads)]
    df = spark.createDataFrame(rows, "article_id long, headers map<string,string>, body string")
    out = {}
    for r in validity.article_violations(df, **options).collect():
        out.setdefault(r.article_id, set()).add((r.header, r.reason))
    return out


def test_validity(spark):
    got = violations(spark, *[{**BASE, k: v} for k, v, _ in BAD], {**BASE, **GOOD}, BASE)
    for i, (k, v, reason) in enumerate(BAD):
        assert (k, reason) in got[i], (k, v)
        assert {h for h, _ in got[i]} == {k}, (k, v, got[i])
    assert got.get(len(BAD)) is None and len(BAD) + 1 not in got


def test_validity_of_general_rules(spark):
    heads = [{**BASE, "X-A": "a\0b"}, {**BASE, "X-A": "é"}, {**BASE, "X-A": "a\rb"}, {**BASE, "X-A": "a\nb"}, {**BASE, "X-A": "a\n \n b"}, {**BASE, "X-A": "y" * 994}, {**BASE, "X-A": "y" * 993}, {**BASE, "X A": "y"}, {**BASE, "subject": "again"}, {"From": "a@b.c"}, {**BASE, "Control": "cancel <a@b>", "Supersedes": "<a@b>"}, BASE, BASE, BASE, {**BASE, "X-A": None}, {**BASE, "Path": ".POSTED!x"}]
    got = violations(spark, *heads, bodies={11: "a\0", 12: "a\rb", 13: "z" * 999})
    want = {0: "nul-in-header", 1: "non-ascii-header", 2: "bare-cr", 3: "invalid-folding", 4: "empty-folded-line", 5: "header-line-too-long", 7: "invalid-header-name", 8: "duplicate-header-name-case-insensitive", 10: "control-and-supersedes-mutually-exclusive", 11: "nul-in-body", 12: "bare-cr-in-body", 13: "body-line-too-long", 15: "invalid-path"}
    for i, reason in want.items():
        assert [r for _, r in got[i]] == [reason], i
    assert got[9] == {("Newsgroups", "missing-mandatory-header"), ("Subject", "missing-mandatory-header"), ("Newsgroups", "invalid-newsgroups")}
    assert 6 not in got and 14 not in got
    assert 0 not in violations(spark, {**BASE, "Path": ".POSTED!x"}, allow_staging_path=True)


def style(spark, headers=None, groups="a.b", followups=(), body="x\n", limits=None, received="2024-01-01 12:00:00"):
    h = {"Subject": "s", "Date": "Mon, 1 Jan 2024 10:00:00 +0000", **(headers or {})}
    df = spark.createDataFrame([(0, h, body, groups.split(","), list(followups), "text")], "article_id long, headers map<string,string>, body string, groups array<string>, followups array<string>, article_type string")
    df = df.withColumns({"skip": F.array().cast("array<string>"), "body_size": F.octet_length("body").cast("long"), "header_size": X.header_size(F.col("headers")), "line_stats": X.line_statistics(F.col("body")), "received_s": F.unix_timestamp(F.lit(received))})
    df = df.withColumn("total_size", F.col("body_size") + F.col("header_size"))
    return df.select(structure.style_code(limits or structure.StyleLimits()).alias("c")).first()["c"]


L = structure.StyleLimits


@pytest.mark.parametrize(
    ("want", "given"),
    [
        (0, {}), (1, {"headers": {"Control": "newgroup x"}}), (0, {"headers": {"Control": "cancel <a@b>"}}), (51, {"headers": {"Supersedes": "<a@b>"}}), (4, {"headers": {"Distribution": "moon"}, "limits": L(distributions=("local",))}),
        (5, {"headers": {"Content-Type": "text/html"}}), (3, {"headers": {"Approved": "x"}}), (6, {"groups": "a,b,c", "limits": L(max_crosspost=2)}), (7, {"followups": ["a", "b"], "limits": L(max_followup=1)}), (8, {"groups": "a,b", "limits": L(max_fup_no_crosspost=1)}),
        (96, {"limits": L(max_body={"text": 1})}), (97, {"limits": L(max_header={"text": 1})}), (98, {"limits": L(max_total={"text": 1})}), (11, {"headers": {"Subject": "Re: x"}}), (0, {"headers": {"Subject": "Re: x", "References": "<a@b>"}}),
        (12, {"body": "y" * 20, "limits": L(max_line_length=10)}), (13, {"body": "> a\n> b\nc", "limits": L(max_quoted_ratio=0.5)}), (15, {"body": "a\n\n\n", "limits": L(max_empty_ratio=0.5)}), (16, {"body": "<HTML>"}), (25, {"groups": "a.b,c.d", "limits": L(max_hierarchies=1)}),
        (54, {"groups": "x.y", "limits": L(forbidden_groups=(r"^x\.",))}), (19, {"headers": {"Date": "never"}}), (19, {"headers": {"Date": "5 Jan 2024 10:00:00 +0000"}}), (58, {"limits": L(too_old_s=60)}), (21, {"headers": {"X": "y" * 30}, "limits": L(max_header_length=29)}),
        (22, {"headers": {"To": "a@b"}}), (24, {"headers": {"In-Reply-To": "<a@b>"}}), (20, {"headers": {"Path": " "}}),
    ],
)
def test_style(spark, want, given):
    assert style(spark, **given) == want


def test_style_joins(spark):
    a = spark.createDataFrame([(0, ["a.b", "c.d"], {"X-Trace": "1", "Path": "p"}), (1, ["a.b"], {"Path": "p"})], "article_id long, groups array<string>, headers map<string,string>")
    pairs = spark.createDataFrame([(1, "a", "zzz"), (2, r"a\.", r"C\.d")], "ord int, left string, right string")
    assert [(r.article_id, r.ord) for r in structure.forbidden_crossposts(a, pairs).collect()] == [(0, 2)]
    names = spark.createDataFrame([(1, "^x-", "^x-ok"), (2, "^path$", "path")], "ord int, name_pattern string, exception_pattern string")
    assert [(r.article_id, r.name) for r in structure.forbidden_header_names(a, names).collect()] == [(0, "X-Trace")]


def test_mime_parts_leave_by_size():
    import pyarrow as pa

    bodies = ["x" * 300_000] * 40 + [None] * 9000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies))), *(pa.nulls(len(bodies), pa.string()) for _ in range(3)), pa.array(bodies)], ["article_id", "content_type", "cte", "disposition", "body"])
    got = list(content.part_batches([batch], lambda a: [(a[0], 1, "1", 1, "text/plain", None, None, {"k": "v"}, None, a[4] or "", False, None)]))
    assert max(b.nbytes for b in got) < 4_000_000 and max(b.num_rows for b in got) <= content.PART_ROWS
    assert [x for b in got for x in b.column("article_id").to_pylist()] == list(range(len(bodies)))
    assert got[0].column("params")[0].as_py() == [("k", "v")] and sum(len(x) for b in got for x in b.column("body").to_pylist()) == 12_000_000


def test_mime(spark):
    body = 'x\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: image/png;\n name="q;\\"r.png"\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\nQUJD\n--b--\n'
    rows = [(0, 'multipart/alternative; boundary="b"', None, None, body), (1, "multipart/mixed; boundary=b", None, None, body), (2, "multipart/alternative; boundary=zz", None, None, body), (3, None, None, None, "plain"), (4, 'text/plain; x="', None, None, "y"), (5, "text/html", None, None, None)]
    parts = content.mime_parts(spark.createDataFrame(rows, "article_id long, content_type string, cte string, disposition string, body string"))
    got = {(r.article_id, r.location): (r.media_type, r.filename, r.malformed) for r in parts.collect()}
    assert got[(0, "1.2")] == ("image/png", 'q;"r.png', False) and got[(0, "1.1")][0] == "text/plain"
    assert got[(2, "1")][2] and got[(3, "1")] == ("text/plain", None, False) and got[(4, "1")][2] and len(got) == 10
    codes_ = {r.article_id: r.legacy_code for r in content.mime_verdict(parts, ["text/plain", "image/png"], ["text/html"], ["multipart/alternative"]).collect()}
    assert codes_ == {0: 111, 1: 109, 2: 113, 4: 113, 5: 110}
    deep = ("multipart/alternative; boundary=b", "")
    for i in range(10):
        deep = (f"multipart/alternative; boundary=d{i}", f"--d{i}\nContent-Type: {deep[0]}\n\n{deep[1]}\n--d{i}--")
    assert content.mime_parts(spark.createDataFrame([(0, deep[0], None, None, deep[1])], "article_id long, content_type string, cte string, disposition string, body string")).where("reason = 'depth'").count() == 1


def test_payloads(spark):
    line, short = "A" * 64, "B" * 10
    bodies = ["\n".join([line] * 13 + [short, short]), "\n".join(["> " + line] * 13), "x\n" + "\n".join([line] * 5) + "\n\n" + "\n".join([line] * 4), "C" * 12_000, None, ""]
    runs = {(r.article_id, r.first_line): (r.lines, r.decoded_bytes) for r in content.base64_runs(spark.createDataFrame(list(enumerate(bodies)), "article_id long, body string")).collect()}
    assert runs == {(0, 0): (14, 13 * 48 + 7), (2, 1): (5, 240), (2, 7): (4, 192), (3, 0): (1, 9000)}
    frame = spark.createDataFrame([(0, 0, 12, 4096), (1, 0, 12, 4095), (2, 0, 1, 8192), (3, 0, 2, 9000)], "article_id long, first_line int, lines long, decoded_bytes long")
    assert sorted(r.article_id for r in content.base64_code(frame).collect()) == [0, 2]
    armour = "a\n-----BEGIN PGP MESSAGE-----\nx\n-----END PGP MESSAGE-----\nb"
    assert one(spark, content.armour_removed(F.col("b")), b=armour) == "a\nb"
    assert one(spark, content.armour_removed(F.col("b")), b=armour.replace("END PGP", "END XXX")) == armour.replace("END PGP", "END XXX")
    many = "-----BEGIN PGP MESSAGE-----\n" * 2000
    assert one(spark, content.armour_removed(F.col("b")), b=many) == many
    assert one(spark, content.binary_code(F.col("b"), F.lit("text")), b="begin 644 f\n" + "M" * 30 + "\n") == 52
    assert one(spark, content.binary_code(F.col("b"), F.lit("binary")), b="q\n=ybegin line=1") == 102


def test_reputation(spark):
    providers = spark.createDataFrame([("p", 1, "z", [4], ["127.0.0.2"], ["127.255.255.254"], "reject", "accept", "reject"), ("q", 2, "y", None, [], [], "mark", "reject", None)], "id string, ord int, zone string, ip_versions array<int>, positive_codes array<string>, refused_codes array<string>, action string, on_error string, on_timeout string")
    a = spark.createDataFrame([(i, f"192.0.2.{i}") for i in range(6)] + [(9, "2001:db8::1")], "article_id long, client_ip string")
    keys = reputation.ip_keys(a)
    listed = spark.createDataFrame([("p", "0.2.0.192", "NOERROR", ["127.0.0.2"]), ("p", "1.2.0.192", "NOERROR", ["127.0.0.3"]), ("p", "2.2.0.192", "NOERROR", ["127.0.0.2", "127.255.255.254"]), ("p", "3.2.0.192", "SERVFAIL", None), ("p", "4.2.0.192", "NXDOMAIN", None), ("q", "4.2.0.192", "REFUSED", None), ("q", "5.2.0.192", "NOERROR", ["1.1.1.1"])], "provider string, key string, rcode string, answers array<string>")
    found = reputation.lookups(keys, providers, listed)
    status = {(r.article_id, r.provider): r.status for r in found.collect()}
    assert [status[(i, "p")] for i in range(5)] == ["listed", "clean", "error", "error", "clean"] and status[(5, "q")] == "listed" and (9, "p") not in status and (9, "q") in status
    assert sorted((r.article_id, r.provider) for r in reputation.first_rejection(found, 56).collect()) == [(0, "p"), (3, "p"), (4, "q")]


def test_decisions(spark):
    rows = [(0, True), (34, True), (48, True), (95, True), (34, False), (0, False)]
    df = spark.createDataFrame(rows, "code int, audit boolean").select("*", decide.resolve(F.col("code"), F.col("audit")).alias("f"))
    assert [(r.f.nntp_result, r.f.would_reject) for r in df.collect()] == [("accepted", False), ("accepted", True), ("rejected", False), ("rejected", False), ("rejected", False), ("accepted", False)]
    f = lambda **k: one(spark, decide.resolve(F.col("c"), F.lit(False), **k), c=34)
    assert (f(on_reject="discard").nntp_result, f(on_reject="save").nntp_result, f(on_reject="save").save, f(on_reject="nonsense").action, f(requested=F.lit("discard")).nntp_result) == ("discarded", "rejected", True, "reject", "discarded")
    g = one(spark, decide.resolve(F.col("c"), F.lit(False), on_accept="reject"), c=0)
    assert (g.legacy_code, g.nntp_result) == (47, "rejected")
    a = spark.createDataFrame([(i,) for i in range(3)], "article_id long")
    r = lambda *x: spark.createDataFrame(list(x), "article_id long, legacy_code int")
    steps = {"style": r((0, 5)), "banlist": r((0, 34), (1, 34))}
    first = {x.article_id: x.f for x in decide.combine(a, steps).select("article_id", decide.first_failure(F.col("results")).alias("f")).collect()}
    assert first[0].step == "style" and first[1].legacy_code == 34 and first[2] is None
    got = decide.enforce(a, [(n, lambda open_, d=d: d.join(open_, "article_id", "left_semi")) for n, d in steps.items()]).collect()
    assert sorted((x.article_id, x.step) for x in got) == [(0, "style"), (1, "banlist")]
    assert decide.explain(decide.combine(a, steps)).count() == 6
    own = decide.combine(a.withColumn("own", F.lit(7)), {"own": F.col("own"), **steps})
    assert [x.f.legacy_code for x in own.select(decide.first_failure(F.col("results")).alias("f")).collect()] == [7] * a.count()
    assert decide.explain(own, "own").where("step = 'inn' AND legacy_code = 7").count() == a.count()
    assert one(spark, decide.server_mode("closed", F.lit(0))) == 48 and one(spark, decide.server_mode("disabled", F.lit(9))) == 0


def test_privacy(spark):
    key = b"k" * 32
    for k in (key, b"short", b"long" * 40):
        assert one(spark, X.hmac_sha256(F.col("v"), k), v="value") == hmac.new(k, b"value", hashlib.sha256).hexdigest()
    token = privacy.lookup_token("auth_user", F.col("v"), key)
    assert one(spark, token, v="bob") == "h1:" + hmac.new(key, b"auth_user\0bob", hashlib.sha256).hexdigest() and one(spark, token, v="") == ""
    stored = spark.createDataFrame([("bob",), ("",), (None,)], "v string").select(privacy.protect(F.col("v"), "encrypted", key, "p").alias("s")).cache()
    assert [r.x for r in stored.select(privacy.reveal(F.col("s"), F.lit("encrypted"), key, "p").alias("x")).collect()] == ["bob", "", ""]
    with pytest.raises(Exception, match="."):
        stored.where("s <> ''").select(privacy.decrypt_token(F.col("s"), key, "other")).collect()
    assert [one(spark, privacy.redact(F.lit(v), "redacted")) for v in ("abcde", "abcdef", "")] == ["a…", "abc…ef", ""]
    h = spark.createDataFrame([({"From": "a", "Agent": "x", "NNTP-Posting-Host": "h"}, "192.0.2.1", "", True), ({"From": "b"}, "192.0.2.1", "bob", False)], "headers map<string,string>, client_ip string, user string, tor boolean")
    got = [r.headers for r in privacy.rewrite(h, key, sender="replace", delete=["agent"], posting_host="plain", posting_account="delete").collect()]
    assert got[0]["Agent"] is None and got[0]["Path"] == "tor-network!not-for-mail" and got[0]["X-TOR"] == "yes" and got[1]["Sender"] == "bob@news.example.invalid"
    assert got[1]["Injection-Info"] == 'news.example.invalid; posting-host="192.0.2.1"' and got[0]["NNTP-Posting-Host"] is None
    kept = [r.headers for r in privacy.rewrite(h, key, sender="preserve", path="preserve", keep=["From"]).collect()]
    assert {k for k, v in kept[1].items() if v is not None} == {"From"}


def test_threads(spark):
    posts = [("a", None, "local", True), ("b", "a", "", True), ("c", "b", "usenet", True), ("d", "c", "", True), ("e", "b", "", False), ("f", "e", "", True), ("g", "z", "", True), ("h", "b", "moon", True), ("i", "h", "", True), ("j", "k", "", True), ("k", "a", "", True)]
    posts += [(f"n{i}", f"n{i - 1}" if i else "a", "", True) for i in range(40)]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(posts)], "message_id string, parent_id string, distribution string, accepted boolean, ord long")
    got = {r.message_id: (r.local, r.legacy_code) for r in threads.local_threads(df).collect()}
    assert [got[x] for x in "abcdefghijk"] == [(True, 0), (True, 0), (False, 0), (False, 0), (True, 0), (False, 0), (False, 0), (False, 108), (False, 0), (False, 0), (True, 0)]
    assert all(got[f"n{i}"] == (True, 0) for i in range(40))


def test_history(spark):
    e = spark.createDataFrame([(1, 10, "x"), (2, 20, "x"), (3, None, "y")], "id long, received_us long, client_ip string")
    hits = spark.createDataFrame([(1, "r"), (2, "r")], "event_id long, rule_id string")
    saved = spark.createDataFrame([(1, "p1"), (2, "p2")], "event_id long, path string")
    left = history.purge(e, hits, saved, 15)
    assert sorted(r.id for r in left[0].collect()) == [2, 3]  # an event without a time stays
    assert [r.event_id for r in left[1].collect()] == [2] and {r.path: r.event_id for r in left[2].collect()} == {"p1": None, "p2": 2} and left[3].first().affected == 1
    assert history.query_events(e, limit=0).count() == 3 and history.query_events(e, client_ip="x", limit=1).first().id == 2
    merged = history.merge_history(e.withColumn("article_type", F.lit("binary")), e).collect()
    assert {r.article_type for r in merged} == {"binary", "text"} and {r.identity_storage_mode for r in merged} == {"plain"}


def test_custom_rule(spark):
    a = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "article_id long, subject string")

    def rule(row):
        return {0: None, 1: "34", 2: "no", 3: 0}.get(row["article_id"]) if row["article_id"] < 4 else 1 / 0

    got = lambda policy: [(r.legacy_code, r.message) for r in decide.custom_rule(a, rule, ["article_id", "subject"], policy).orderBy("article_id").collect()]
    assert got("accept") == [(0, None), (34, None), (63, "no"), (0, None), (0, None)] and got("reject")[4][0] == 63


def test_rule_rejection_defaults_cap_and_scan(spark):
    a = spark.createDataFrame([(1, "text", "s", "red word here"), (2, "binary", "s", "red word here"), (3, "odd", "s", "x" * 40_000 + "red"), (4, "binary", "s", "x" * 40_000 + "red")], "article_id long, article_type string, subject string, body string")
    words = spark.createDataFrame([("w1", 1, "nothing", ["text"], None, None, None), ("w2", 2, "red", ["text", "binary"], 777, "OWN-777", "go away"), ("w3", 3, "red", None, None, None, None)], "id string, ord int, pattern string, article_types array<string>, legacy_code int, reason_code string, response string")
    row = lambda r: (r.legacy_code, r.rule_id, r.reason_code, r.response)
    got = {r.article_id: row(r) for r in content.badword_verdict(content.badword_hits(a, words, cap=1)).collect()}
    assert got == {2: (777, "w2", "OWN-777", "go away"), 4: (777, "w2", "OWN-777", "go away")}  # text's first rule is w1, other types' is w3
    got = {r.article_id: row(r) for r in content.badword_verdict(content.badword_hits(a, words, scan=None)).collect()}
    assert got[1] == (777, "w2", "OWN-777", "go away") and got[3] == (29, "w3", None, None)
    bans = words.withColumn("target", F.lit("body"))
    got = {r.article_id: row(r) for r in rules.ban_verdict(rules.ban_hits(a, bans)).collect()}
    assert got == {1: (777, "w2", "OWN-777", "go away"), 2: (777, "w2", "OWN-777", "go away"), 4: (777, "w2", "OWN-777", "go away")}
    got = {r.article_id: row(r) for r in rules.ban_verdict(rules.ban_hits(a, bans.where("id = 'w3'"), scan={})).collect()}
    assert got[3] == (34, "w3", None, None)


def test_style_order_modules_and_lists(spark):
    a = spark.createDataFrame([(1, {"Date": "x", "Bad": "1"}, "b", ["a.b", "c.d"], ["poster"]), (2, {"Date": "Mon, 01 Jan 2024 10:00:00 GMT"}, "b", ["a.b"], ["no.such"])], "article_id long, headers map<string,string>, body string, groups array<string>, followups array<string>")
    a = a.withColumns({"article_type": F.lit("text"), "skip": F.array().cast("array<string>"), "received_s": F.lit(1704103200 + 60), "body_size": F.lit(1), "header_size": F.lit(1), "total_size": F.lit(2), "line_stats": X.line_statistics(F.col("body"))})
    a = structure.known_group_flags(a, spark.createDataFrame([("a.b",)], "group string"))
    flags = {r.article_id: (r.unknown_group, r.unknown_followup) for r in a.collect()}
    assert flags == {1: (True, False), 2: (False, True)}
    none, unknown = structure.StyleLimits(), (F.col("unknown_group"), F.col("unknown_followup"))
    codes = lambda **o: {r.article_id: r.c for r in a.select("article_id", structure.style_code(none, *unknown, **o).alias("c")).collect()}
    assert codes() == {1: 17, 2: 18}
    assert codes(forbidden_pair=F.size("groups") > 1) == {1: 2, 2: 18}
    assert codes(list_readable=False) == {1: 37, 2: 37}
    assert codes(modules=structure.MODULES - {"groups"}) == {1: 19, 2: 0}
    assert codes(modules=structure.MODULES - {"groups", "dates"}, forbidden_header=F.array_contains(F.map_keys("headers"), "Bad")) == {1: 53, 2: 0}
    assert codes(modules=frozenset()) == {1: 0, 2: 0}


def test_transformed_articles_are_checked_again(spark):
    good = {"From": "a@b.org", "Newsgroups": "a.b", "Subject": "s", "Date": "Mon, 01 Jan 2024 10:00:00 GMT", "Path": ".POSTED!x"}
    df = spark.createDataFrame([(1, good, "b"), (2, good | {"Injection-Info": "host; y=1"}, "b")], "article_id long, headers map<string,string>, body string")
    assert [tuple(r) for r in validity.transformed_verdict(df).collect()] == [(2, 118, "Injection-Info", "invalid-injection-info")]


def test_header_tokens():
    ok = validity.valid_state_header
    assert ok("From", 'Ann (x (y)) <a.b@c.org>, "q, r" <"s t"@[1.2.3.4]>') and not ok("From", "a@b, ") and not ok("From", "<a @b>") and not ok("From", "(open a@b") and not ok("Sender", "a@b, c@d")
    assert ok("Date", "Mon, 01 Jan 2024 10:00:60 +0130 (zone)") and not ok("Date", "Mon, 32 Jan 2024 10:00 GMT") and not ok("Date", "1 Jan 2024 10 :00 GMT") and not ok("Date", "1 Jan 2024 10:00 +2400")
    assert ok("Content-Type", 'text/plain; charset="a;b" ; x = y') and not ok("Content-Type", "text / plain") and not ok("Content-Type", "a/b; x=1; X=2") and not ok("Content-Type", "a/b;")
    assert ok("User-Agent", "a/1 (c) b / 2 d") and not ok("User-Agent", "a/b/c") and ok("MIME-Version", "1 . 0 (x)") and not ok("MIME-Version", "1.1")
    assert ok("References", "<a@b> (c)<d@e>") and not ok("References", "(c)") and ok("Archive", "No; filename=x") and not ok("Content-Disposition", "")
    assert validity.parse_injection_info(r'n.org; posting-host="a\"b"; x-y=z') == [("", "n.org"), ("posting-host", 'a"b'), ("x-y", "z")]


def test_metrics_add_to_scores(spark):
    a = spark.createDataFrame([(1, "text", ["a", "b"], 70)], "article_id long, article_type string, groups array<string>, body_size long")
    table = spark.createDataFrame([("m1", 1, -1, "", "add_metric", "x", None), ("m2", 2, -2, "", "add_metric", "x", "body_bytes"), ("m3", 3, -3, "", "add_metric", "y", "none")], "id string, ord int, priority int, pattern string, action string, score_name string, metric string")
    table = table.withColumns({"target": F.lit("subject"), "match_type": F.lit("contains")})
    got = rules.named_scores(rules.ban_hits(a.withColumn("subject", F.lit("s")), table), global_limit=71.0).first()
    assert (got.scores, got.over) == ({"x": 72.0, "y": 0.0}, "x")


def test_enforced_expressions_share_a_scan(spark):
    a = spark.createDataFrame([(i, i % 6) for i in range(60)], "article_id long, n int")
    code = lambda k: F.when(F.col("n") == k, 10 + k).otherwise(0)
    table = lambda k: lambda open_: a.join(open_, "article_id", "left_semi").select("article_id", code(k).alias("legacy_code"))
    for steps in ([("a", code(1)), ("b", code(2)), ("c", table(3)), ("d", code(4))], [("a", table(1)), ("b", code(2)), ("c", code(3)), ("d", table(4))]):
        got = decide.enforce(a, steps)
        assert sorted(map(tuple, got.collect())) == [(i, "_abcd"[i % 6], 10 + i % 6) for i in range(60) if 1 <= i % 6 <= 4]
    assert sorted(x[0] for x in decide.enforce(a, [("a", code(1)), ("b", F.when(F.col("n") < 2, 7))]).groupBy("article_id").count().where("count > 1").collect()) == []
