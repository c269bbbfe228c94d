"""Rule matching: small rule tables joined with articles by pattern, address range or equality.

Rule tables are broadcast (they are configuration, a few thousand rows at most; ``checked_rules`` refuses more).
The first match by (priority, order) is always a ``min_by``; sequences with stops are cut by running windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from artisieve.functions import text as X
from artisieve.operators import automaton

MAX_RULES = 100_000
#: So many rules are tried as literal expressions in one projection; of more, those whose required strings occur.
LITERAL_RULES = 256
#: Bytes of a body that word and ban rules read, by article type; other types are read as text.
SCAN = {"text": 32_768, "binary": 1_048_576}


def small(table: DataFrame) -> DataFrame:
    """A configuration table, broadcast after a check of its number of rows."""
    if table.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rows of configuration")
    return F.broadcast(table)


def checked_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules with defaults (id, ord, priority, match_type...), broadcast after a check of their number."""
    defaults = {"ord": F.lit(0), "priority": F.lit(0), "enabled": F.lit(True), "match_type": F.lit("regex"), "case_sensitive": F.lit(False), "article_types": F.lit(None).cast("array<string>"), "score": F.lit(None).cast("double"), "name": F.lit(None).cast("string"), "action": F.lit("reject")}
    for name, value in defaults.items():
        rules = rules.withColumn(name, F.coalesce(F.col(name), value) if name in rules.columns else value)
    return small(rules.where("enabled"))


def valid_rules(rules: DataFrame, column: str = "pattern") -> DataFrame:
    """Marks rules whose pattern does not compile as disabled; only those (one check for each rule, on the driver)."""
    spark = rules.sparkSession
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    bad = []
    for r in checked_rules(rules).where(f"match_type = 'regex' AND {column} IS NOT NULL").select("id", column).collect():
        try:
            compile_(r[column])
        except Exception:  # the JVM reports a syntax error of this pattern
            bad.append(r["id"])
    enabled = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in rules.columns else F.lit(True)
    return rules.withColumn("enabled", enabled & ~F.col("id").isin(bad))


def matches(value: Column, pattern: Column, match_type: Column, case_sensitive: Column) -> Column:
    """Exact, contains or regex (the default), with the rule's case option; a null value never matches."""
    low = lambda c: F.when(case_sensitive, c).otherwise(F.lower(c))
    regex = F.when(case_sensitive, pattern).otherwise(F.concat(F.lit("(?iu)"), pattern))
    found = F.when(match_type == "exact", low(value) == low(pattern)).when(match_type == "contains", F.contains(low(value), low(pattern))).otherwise(F.rlike(value, regex))
    return F.coalesce(found, F.lit(False))


def scoped(types: Column, kind: Column) -> Column:
    return types.isNull() | (F.size(types) == 0) | F.array_contains(types, kind)


def scan_body(articles: DataFrame, limits: dict[str, int] | None) -> DataFrame:
    """``articles`` with the body cut to the bytes that its type allows, less a character cut in two; no limit, or one of 0, leaves it
    whole."""
    if not limits or "article_type" not in articles.columns:
        return articles
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("article_type")), F.lit(limits.get("text", 0)))
    cut = F.regexp_replace(F.substring(F.col("body").cast("binary"), F.lit(1), most).cast("string"), r"\x{FFFD}{1,3}\z", "")
    return articles.withColumn("body", F.when((most > 0) & (F.octet_length("body") > most), cut).otherwise(F.col("body")))


def ranked_by_type(rules: DataFrame, order: list[Column], cap: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The rules that an article type is tried with, as (type, rank, ...), at most ``cap`` each; and the type under which an
    article finds its own. Types that no rule names share ``*``."""
    named = [r[0] for r in rules.select(F.explode("article_types")).distinct().orderBy("col").collect()]  # configuration
    every = F.array(*map(F.lit, [*named, "*"]))
    each = rules.withColumn("type", F.explode(F.when(F.size(F.coalesce("article_types", F.array().cast("array<string>"))) == 0, every).otherwise(F.array_distinct("article_types"))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(*order))).where(F.col("rank") <= cap)
    return ranked, lambda kind: F.when(kind.isin(named), kind).otherwise("*")


Test = Callable[[Callable[[str], Column], Callable[[str | None, Column], Column]], tuple[Column, Column]]


def tried(articles: DataFrame, rules: DataFrame, test: Test, reads: Callable[[Row], list[tuple[str, str | None, str | None]] | None], texts: Callable[[str], Column]) -> DataFrame:
    """(article_id, ...) for each rule that an article meets: ``test`` gives a rule's condition and the struct to return, from a
    function that gives the rule's columns and one that takes a text's name (None: any that the rule reads) and the match with
    that text, and may know the match without it. Few rules become literals, whose patterns are compiled once. Of many, those are
    tried whose required strings occur in the texts that they read, and plain words are decided there (``automaton``): ``reads``
    gives a rule's (text name, pattern, match type), or None for one that has to be tried always, ``texts`` the column of a name."""
    rows = rules.limit(LITERAL_RULES + 1).collect()
    if not rows:
        return met_rules(articles, rules, test)
    if len(rows) <= LITERAL_RULES:
        kinds = dict(rules.dtypes)
        each = (test(lambda c, row=row: F.lit(row[c]).cast(kinds[c]), lambda _, match: match) for row in rows)
        found = articles.select("article_id", F.explode(F.array_compact(F.array(*(F.when(met, out) for met, out in each)))).alias("x"))
        return found.select("article_id", "x.*")
    rules = rules.withColumn("needle", F.xxhash64(*[c for c in ("target", "targets", "match_type", "pattern", "case_sensitive") if c in rules.columns]))
    distinct = rules.dropDuplicates(["needle"]).collect()  # configuration of a checked size
    wanted, always = automaton.indexed((r["needle"], bool(r["case_sensitive"]), reads(r)) for r in distinct)
    parts = []
    if always:
        slow = rules.join(F.broadcast(rules.sparkSession.createDataFrame([(k,) for k in always], "needle long")), "needle", "left_semi")
        parts.append(tried(articles, slow, test, reads, texts) if len(always) < len(distinct) and slow.count() <= LITERAL_RULES else met_rules(articles, slow, test))
    if wanted:
        named = articles.withColumn("__found", F.explode(automaton.candidates(articles.sparkSession, wanted, texts)))
        bit = {name: 1 << i for i, name in enumerate(sorted(wanted))}

        def known(name: str | None, match: Column) -> Column:
            seen = F.col("__found.seen")
            held = seen > 0 if name is None else seen.bitwiseAND(F.lit(bit.get(name, 0)).cast("long")) != 0
            return F.when(seen.isNotNull(), held).otherwise(match)

        parts.append(met_rules(named, rules, test, F.col("__found.needle") == F.col("r_needle"), known))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def met_rules(articles: DataFrame, rules: DataFrame, test: Test, on: Column | None = None, known: Callable[[str | None, Column], Column] = lambda _, match: match) -> DataFrame:
    """The join of articles and rules that ``tried`` falls back to: every pair, unless ``on`` says which."""
    met, out = test(lambda c: F.col(f"r_{c}"), known)
    right = small(rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns]))
    return articles.join(right, met if on is None else on & met).select("article_id", out.alias("x")).select("article_id", "x.*")


def network_candidates(networks: DataFrame, key: Column) -> tuple[DataFrame, Column]:
    """Networks as (network, family, bits, prefix), and the array of the (family, bits, prefix) under which an address ``key`` can
    be found: one for each prefix length in use, of which there are 162 at most."""
    nets = networks.select("network").where("network IS NOT NULL").distinct().withColumn("p", X.cidr_prefix(F.col("network"))).where("p IS NOT NULL").select("network", "p.*")
    used = sorted(tuple(r) for r in nets.select("family", "bits").distinct().collect())  # at most 33 + 129 rows
    entry = lambda family, bits: F.when(key["family"] == family, F.struct(F.lit(family).alias("family"), F.lit(bits).alias("bits"), X.key_prefix(key["key"], F.lit(bits)).alias("prefix")))
    none = F.array().cast("array<struct<family:int,bits:int,prefix:string>>")
    return nets, F.array_compact(F.array(*(entry(*u) for u in used))) if used else none


def cidr_matches(addresses: DataFrame, networks: DataFrame, ip_col: str = "client_ip") -> DataFrame:
    """(ip, network) for each distinct address and each network that holds it: an equality join on prefixes, an address once for
    each prefix length in use. Networks may be many; values that are no address or network match nothing."""
    ips = addresses.select(F.col(ip_col).alias("ip")).distinct().withColumn("k", X.ip_key(F.col("ip"))).where("k IS NOT NULL")
    nets, keys = network_candidates(networks, F.col("k"))
    return ips.select("ip", F.inline(keys)).join(nets, ["family", "bits", "prefix"]).select("ip", "network")


def longest_prefix(addresses: DataFrame, networks: DataFrame, ip_col: str = "client_ip") -> DataFrame:
    """(ip, network, bits): for each distinct address the most specific network that holds it, ties to the smaller text."""
    found = cidr_matches(addresses, networks, ip_col).withColumn("bits", X.cidr_prefix(F.col("network"))["bits"])
    best = found.groupBy("ip").agg(F.min(F.struct(-F.col("bits"), "network")).alias("b"))
    return best.select("ip", F.col("b.network").alias("network"), (-F.col("b.col1")).alias("bits"))


def in_networks(ip: Column, networks: list[str]) -> Column:
    """Whether an address lies in one of a few constant networks."""
    ranges = F.array(*(X.cidr_range(F.lit(n)) for n in networks))
    return X.bound(X.ip_key(ip), lambda key: F.exists(ranges, lambda r: X.in_range(key, r))) if networks else F.lit(False)


def target_value(target: Column, body: str = "body") -> Column:
    """The text that a rule's target names."""
    name = F.substring(target, 8, 1000)
    return (
        F.when(target == "body", F.col(body)).when(target == "subject", F.col("subject")).when(target == "from.address", X.normalize_email(F.col("from")))
        .when(target == "from.raw", F.col("from")).when(target == "client.ip", F.col("client_ip")).when(target == "client.domain", F.col("client_domain"))
        .when(target == "auth.user", F.col("user")).when(target == "newsgroups", F.col("newsgroups"))
        .when(target.startswith("header."), F.coalesce(F.element_at("headers", name), F.element_at("headers", F.lower(name))))
    )


def metric_values(articles: DataFrame) -> Column:
    """Map of the metrics that ``add_metric`` rules can name, as far as the articles have their columns."""
    sources = {"body_bytes": ("body_size", "body_size"), "header_bytes": ("header_size", "header_size"), "total_bytes": ("total_size", "total_size"), "body_lines": ("line_stats", "line_stats.lines"), "lines": ("line_stats", "line_stats.lines")}
    found = {name: F.col(value) for name, (column, value) in sources.items() if column in articles.columns}
    found |= {name: F.size(name) for name in ("groups", "followups") if name in articles.columns}
    return F.create_map(*[x for name, c in found.items() for x in (F.lit(name), c.cast("double"))]).cast("map<string,double>")


def with_targets(articles: DataFrame) -> DataFrame:
    """Adds the columns that targets read, where the input lacks them."""
    for name in ("body", "subject", "from", "client_ip", "client_domain", "user", "newsgroups", "article_type", "profile"):
        if name not in articles.columns:
            articles = articles.withColumn(name, F.lit(None).cast("string"))
    if "headers" not in articles.columns:
        articles = articles.withColumn("headers", F.create_map().cast("map<string,string>"))
    return articles


def ban_hits(articles: DataFrame, rules: DataFrame, cap: int = 2000, scan: dict[str, int] | None = SCAN) -> DataFrame:
    """(article_id, rank, rule_id, target, action, score_name, score, value, header_name, metric_value, own_code, own_reason, own_response):
    matching rules in order, cut after the first that rejects or drops. An article is tried with the first ``cap`` rules of its
    type. ``rules``: id, ord, priority, target, match_type, pattern, action, and optionally header_name_pattern /
    header_value_pattern, include_groups / exclude_groups, exclude_profiles, article_types, and the rule's own legacy_code,
    reason_code and response."""
    rules = checked_rules(rules)
    for c in ("header_name_pattern", "header_value_pattern", "include_groups", "exclude_groups", "value", "score_name", "reason_code", "response", "metric"):
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(None).cast("string"))
    for c, kind in (("exclude_profiles", "array<string>"), ("legacy_code", "int")):
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(None).cast(kind))
    ranked, own_type = ranked_by_type(rules, [F.desc("priority"), F.col("ord")], cap)
    a = scan_body(with_targets(articles), scan).withColumn("__key", X.ip_key(F.col("client_ip")))
    metrics = metric_values(a)

    def test(r: Callable[[str], Column], known: Callable[[str | None, Column], Column]) -> tuple[Column, Column]:
        excluded = F.coalesce(F.array_contains(r("exclude_profiles"), F.col("profile")), F.lit(False))
        grouped = lambda c: F.rlike("newsgroups", F.concat(F.lit("(?i)"), r(c)))
        scope = (own_type(F.col("article_type")) == r("type")) & ~excluded & F.coalesce(grouped("include_groups"), F.lit(True)) & ~F.coalesce(grouped("exclude_groups"), F.lit(False))
        header = F.array_min(F.map_keys(F.map_filter("headers", lambda k, v: F.rlike(k, F.concat(F.lit("(?i)"), r("header_name_pattern"))) & F.rlike(v, F.concat(F.lit("(?i)"), r("header_value_pattern"))))))
        by_ip = X.bound(X.cidr_range(r("pattern")), lambda net: X.in_range(F.col("__key"), net))
        hit = F.when(r("target") == "any.header", header.isNotNull()).when(r("match_type") == "cidr", by_ip).otherwise(known(None, matches(target_value(r("target")), r("pattern"), r("match_type"), r("case_sensitive"))))
        out = {"rank": "rank", "rule_id": "id", "target": "target", "action": "action", "score_name": "score_name", "score": "score", "value": "value"}
        metric = F.when(r("action") == "add_metric", F.try_element_at(metrics, F.coalesce(r("metric"), F.lit("groups"))))
        own = {"metric_value": metric, "own_code": r("legacy_code").cast("int"), "own_reason": r("reason_code"), "own_response": r("response")}
        return scope & hit, F.struct(*(r(c).alias(name) for name, c in out.items()), F.when(r("target") == "any.header", header).alias("header_name"), *(c.alias(name) for name, c in own.items()))

    def reads(r: Row) -> list[tuple[str, str | None, str | None]] | None:
        return None if r["target"] is None or r["target"] == "any.header" or r["match_type"] == "cidr" else [(r["target"], r["pattern"], r["match_type"])]

    found = tried(a, ranked, test, reads, lambda name: target_value(F.lit(name)))
    if ranked.where(F.col("action").isin("reject", "drop")).isEmpty():  # nothing cuts the list
        return found
    before = Window.partitionBy("article_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("stopped", F.coalesce(F.max(F.col("action").isin("reject", "drop")).over(before), F.lit(False))).where("NOT stopped").drop("stopped")


def ban_verdict(hits: DataFrame) -> DataFrame:
    """(article_id, legacy_code, requested_action, rule_id, force_save, reason_code, response) of articles with hits. A
    rejecting rule's own code, reason and response hold where it has them; else 34, and null (see ``codes.with_reason``)."""
    terminal = F.col("action").isin("reject", "drop")
    g = hits.groupBy("article_id").agg(F.min_by(F.when(terminal, F.struct("rule_id", "action", "own_code", "own_reason", "own_response")), F.when(terminal, F.col("rank"))).alias("t"), F.max(F.col("action") == "save").alias("force_save"))
    return g.select("article_id", F.when(F.col("t").isNotNull(), F.coalesce("t.own_code", F.lit(34))).otherwise(0).alias("legacy_code"), F.when(F.col("t.action") == "drop", "discard").alias("requested_action"), F.col("t.rule_id").alias("rule_id"), "force_save", F.col("t.own_reason").alias("reason_code"), F.col("t.own_response").alias("response"))


def named_scores(hits: DataFrame, global_limit: float = 10.0) -> DataFrame:
    """(article_id, scores map, over): a fold of score actions in rule order.

    ``add_score`` adds value, else score, else 1; ``clear_score`` sets 0; ``set_score_limit`` sets a name's limit;
    ``add_metric`` adds the hit's ``metric_value`` (``metric_values``). ``over`` is the first name, by check then by name, whose score
    passes the global limit or its own positive limit; ``verify_score`` checks at its place.
    """
    if "metric_value" not in hits.columns:
        hits = hits.withColumn("metric_value", F.lit(None).cast("double"))
    step = F.struct("rank", "action", F.coalesce("score_name", F.lit("default")).alias("name"), F.col("value").cast("double").alias("value"), "score", "metric_value")
    ordered = hits.groupBy("article_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # at most one step a rule
    empty = F.struct(F.create_map().cast("map<string,double>").alias("s"), F.create_map().cast("map<string,double>").alias("l"), F.lit(None).cast("string").alias("over"))
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))

    def fold(state: Column, e: Column) -> Column:
        now = F.coalesce(F.try_element_at(state["s"], e["name"]), F.lit(0.0))
        s = F.when(e["action"] == "add_score", put(state["s"], e["name"], now + F.coalesce(e["value"], e["score"], F.lit(1.0)))).when(e["action"] == "add_metric", put(state["s"], e["name"], now + F.coalesce(e["metric_value"], F.lit(0.0)))).when(e["action"] == "clear_score", put(state["s"], e["name"], F.lit(0.0))).otherwise(state["s"])
        limits = F.when(e["action"] == "set_score_limit", put(state["l"], e["name"], F.coalesce(e["value"], F.lit(0.0)))).otherwise(state["l"])
        own = F.coalesce(F.try_element_at(state["l"], e["name"]), F.lit(0.0))
        over = F.coalesce(state["over"], F.when((e["action"] == "verify_score") & ((now > global_limit) | ((own > 0) & (now > own))), e["name"]))
        return F.struct(s.alias("s"), limits.alias("l"), over.alias("over"))

    state = ordered.select("article_id", F.aggregate("steps", empty, fold).alias("x"))
    limit = lambda k: F.coalesce(F.try_element_at(F.col("x.l"), k), F.lit(0.0))
    passed = F.array_min(F.map_keys(F.map_filter("x.s", lambda k, v: (v > global_limit) | ((limit(k) > 0) & (v > limit(k))))))
    return state.select("article_id", F.col("x.s").alias("scores"), F.coalesce("x.over", passed).alias("over"))


def config_overrides(hits: DataFrame) -> DataFrame:
    """(article_id, overrides map<string,string>): the last ``set_config`` of each dotted key, for later steps."""
    sets = hits.where("action = 'set_config' AND score_name IS NOT NULL").groupBy("article_id", "score_name").agg(F.max_by("value", "rank").alias("value"))
    return sets.groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("score_name", "value")))).alias("overrides"))


def sender_authorised(articles: DataFrame, senders: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(article_id, legacy_code): 106 where a listed group does not list the sender, 105 where the list is
    unreadable; the first group in order decides. ``articles``: article_id, groups, from; ``senders``: group, sender."""
    each = articles.select("article_id", X.normalize_email(F.col("from")).alias("sender"), F.posexplode("groups").alias("pos", "group"))
    listed = senders.select("group").distinct()
    refused = each.join(listed, "group", "left_semi").join(senders.select("group", "sender").distinct(), ["group", "sender"], "left_anti").withColumn("legacy_code", F.lit(106))
    if unreadable is not None:
        refused = refused.unionByName(each.join(unreadable.select("group").distinct(), "group", "left_semi").withColumn("legacy_code", F.lit(105)))
    return refused.groupBy("article_id").agg(F.min_by("legacy_code", F.struct("pos", "legacy_code")).alias("legacy_code"))


def access_profiles(identities: DataFrame, profiles: DataFrame, defaults: dict[str, dict[str, int]]) -> DataFrame:
    """(kind, lookup, profile_id, limits): the matching profile of highest priority, else the kind's defaults.
    Patterns are tried on distinct identities only."""
    who = identities.select("kind", "lookup").distinct().withColumn("__key", F.when(F.col("kind") == "IP", X.ip_key(F.col("lookup"))))
    rules = checked_rules(profiles).select(*[F.col(c).alias(f"p_{c}") for c in ("id", "ord", "priority", "identity_type", "match_type", "pattern", "limits")])
    rules = F.broadcast(rules.withColumn("p_range", F.when(F.col("p_match_type") == "cidr", X.cidr_range(F.col("p_pattern")))))
    in_net = X.in_range(F.col("__key"), F.col("p_range"))
    hit = F.when(F.col("p_match_type") == "cidr", in_net).otherwise(matches(F.col("lookup"), F.col("p_pattern"), F.col("p_match_type"), F.lit(True)))
    best = who.join(rules, (F.col("kind") == F.col("p_identity_type")) & hit).groupBy("kind", "lookup").agg(F.min_by(F.struct("p_id", "p_limits"), F.struct(-F.col("p_priority"), F.col("p_ord"))).alias("p"))
    fallback = F.create_map().cast("map<string,long>")
    for kind, limits in defaults.items():
        value = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)]).cast("map<string,long>")
        fallback = F.when(F.col("kind") == kind, value).otherwise(fallback)
    return who.join(best, ["kind", "lookup"], "left").select("kind", "lookup", F.col("p.p_id").alias("profile_id"), F.coalesce("p.p_limits", fallback).alias("limits"))


def trusted_profile(articles: DataFrame, profiles: DataFrame) -> DataFrame:
    """(article_id, profile, skip_checks, full_bypass): the first profile by priority that matches.

    Conditions that a profile has: user in authenticated_users, address in source_networks, From, joined groups, headers
    (arrays of name and pattern). ``all`` needs each, ``any`` one; with no condition ``match_all`` decides.
    """
    p = checked_rules(profiles)
    kinds = {"authenticated_users": "array<string>", "source_networks": "array<string>", "from_pattern": "string", "groups_pattern": "string", "header_match": "array<struct<name:string,pattern:string>>", "match_mode": "string", "match_all": "boolean", "skip_checks": "array<string>", "full_bypass": "boolean"}
    for c, kind in kinds.items():
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast(kind))
    p = F.broadcast(p.select(*[F.col(c).alias(f"p_{c}") for c in p.columns]).withColumn("p_ranges", F.transform("p_source_networks", X.cidr_range)))
    a = with_targets(articles).withColumn("__key", X.ip_key(F.col("client_ip")))
    i = lambda v, c: F.coalesce(F.rlike(v, F.concat(F.lit("(?i)"), c)), F.lit(False))
    conditions = F.filter(
        F.array(
            F.when(F.size("p_authenticated_users") > 0, F.coalesce(F.array_contains("p_authenticated_users", F.col("user")), F.lit(False))),
            F.when(F.size("p_source_networks") > 0, F.exists("p_ranges", lambda r: X.in_range(F.col("__key"), r))),
            F.when(F.col("p_from_pattern").isNotNull(), i(F.col("from"), F.col("p_from_pattern"))),
            F.when(F.col("p_groups_pattern").isNotNull(), i(F.col("newsgroups"), F.col("p_groups_pattern"))),
            F.when(F.size("p_header_match") > 0, F.forall("p_header_match", lambda m: i(F.element_at("headers", m["name"]), m["pattern"]))),
        ),
        lambda c: c.isNotNull(),
    )
    ok = F.when(F.size(conditions) == 0, F.coalesce("p_match_all", F.lit(False))).when(F.col("p_match_mode") == "any", F.exists(conditions, lambda c: c)).otherwise(F.forall(conditions, lambda c: c))
    best = a.join(p, scoped(F.col("p_article_types"), F.col("article_type")) & ok).groupBy("article_id").agg(F.min_by(F.struct("p_id", "p_skip_checks", "p_full_bypass"), F.struct(-F.col("p_priority"), F.col("p_ord"))).alias("p"))
    return best.select("article_id", F.col("p.p_id").alias("profile"), F.coalesce("p.p_skip_checks", F.array().cast("array<string>")).alias("skip_checks"), F.coalesce("p.p_full_bypass", F.lit(False)).alias("full_bypass"))
