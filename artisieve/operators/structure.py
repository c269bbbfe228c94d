"""Structural checks: one ordered chain of conditions, the first that fails gives the code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artisieve.functions import text as X
from artisieve.operators.rules import small

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
MAIL_HEADERS = ["to", "cc", "bcc", "received", "return-path", "delivered-to"]


MODULES = frozenset(["style", "headers", "groups", "dates"])
#: Follow-ups that name no group.
NO_GROUP = ["poster", "junk"]


@dataclass
class StyleLimits:
    """Limits of the structural checks; None or 0 switches a check off."""

    max_crosspost: int | None = 10
    max_followup: int | None = 3
    max_fup_no_crosspost: int | None = 3
    max_groups_difference: int | None = None
    max_body: dict[str, int] = field(default_factory=dict)
    max_header: dict[str, int] = field(default_factory=dict)
    max_total: dict[str, int] = field(default_factory=dict)
    max_line_length: int = 0
    max_quoted_ratio: float = 0.0
    max_blank_ratio: float = 0.0
    max_empty_ratio: float = 0.0
    max_hierarchies: int | None = None
    max_hierarchies_followup: int | None = None
    max_header_length: int = 0
    distributions: tuple[str, ...] = ()
    forbidden_groups: tuple[str, ...] = ()
    html_patterns: tuple[str, ...] = (r"<html", r"<body", r"<script")
    html_groups: str | None = None
    allow_html: bool = False
    allow_cancel: bool = True
    allow_mail_headers: bool = False
    moderated: str | None = None
    future_grace_s: int = 86_400
    too_old_s: int | None = None


def rfc_epoch(value: Column) -> Column:
    """Seconds of an article date (weekday and comments dropped), null where it is none. Zone ``±HHMM`` or GMT."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\([^()]*\)", " "), r"^\s*[A-Za-z]{3}\s*,\s*", ""))
    pattern = r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}):(\d{2})(?::(\d{2}))?\s+([+-]\d{4}|GMT|UT|UTC)$"
    part = lambda i: F.regexp_extract(clean, pattern, i)
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(part(2))).cast("int")
    seconds = F.least(F.coalesce(F.nullif(part(6), F.lit("")), F.lit("0")).cast("int"), F.lit(59))
    stamp = F.try_make_timestamp(part(3).cast("int"), month, part(1).cast("int"), part(4).cast("int"), part(5).cast("int"), seconds.cast("decimal(16,6)"), F.lit("UTC"))
    zone = part(7)
    shift = F.when(zone.rlike(r"^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60)).otherwise(0)
    return F.when(clean.rlike(pattern), F.unix_seconds(stamp) - shift)


def hierarchies(groups: Column) -> Column:
    return F.size(F.array_distinct(F.transform(groups, lambda g: F.split_part(g, F.lit("."), F.lit(1)))))


def style_code(
    limits: StyleLimits, unknown_group: Column | None = None, unknown_followup: Column | None = None, forbidden_pair: Column | None = None,
    forbidden_header: Column | None = None, list_readable: bool = True, modules: frozenset[str] = MODULES,
) -> Column:
    """The first failing check's code, 0 where all pass, over the columns headers, body, groups, followups, article_type,
    skip (array), body_size, header_size, total_size, line_stats and received_s.

    Results of joins enter as flags: a group or follow-up that is not in the active list (``known_group_flags``; where the list
    cannot be read, all articles get 37), a forbidden pair of groups, a forbidden header name. Checks of a module
    that is not in ``modules`` are left out.
    """
    h = lambda name: F.coalesce(X.header(F.col("headers"), name), F.lit(""))
    has = lambda name: h(name) != ""
    skip = lambda name: F.array_contains(F.coalesce(F.col("skip"), F.array().cast("array<string>")), name)
    n_groups, n_followups = F.size("groups"), F.size("followups")
    joined = F.array_join("groups", ",")
    rules: list[tuple[Column, Column | int]] = []
    module = "style"

    def add(condition: Column, code: Column | int) -> None:
        if "style" in modules and module in modules:
            rules.append((condition, code))


    module = "headers"
    control = F.lower(F.concat_ws(" ", F.nullif(h("Control"), F.lit("")), F.nullif(h("Also-Control"), F.lit(""))))
    cancel_only = F.lit(limits.allow_cancel) & control.rlike(r"^\s*cancel\b")
    add(~skip("style.control") & (has("Control") | has("Also-Control")) & ~cancel_only, 1)
    add(~skip("style.control") & (has("Supersedes") | has("Replaces") | has("Cancel")), 51)
    if limits.distributions:
        add(has("Distribution") & ~F.lower(F.trim(h("Distribution"))).isin(*limits.distributions), 4)
    add(~skip("style.content_type") & has("Content-Type") & ~F.lower(h("Content-Type")).rlike(r"^\s*text/plain\b"), 5)
    module = "groups"
    if forbidden_pair is not None:
        add(forbidden_pair, 2)
    add(has("Approved") & (~joined.rlike("(?i)" + limits.moderated) if limits.moderated else F.lit(True)), 3)
    if limits.max_crosspost is not None:
        add(n_groups > limits.max_crosspost, 6)
    if limits.max_followup is not None:
        add(n_followups > limits.max_followup, 7)
    if limits.max_fup_no_crosspost is not None:
        add((n_groups > limits.max_fup_no_crosspost) & (n_followups == 0), 8)
    if limits.max_groups_difference is not None:
        add((n_followups - n_groups) > limits.max_groups_difference, 10)
    module = "style"
    for column, most, component in (("body_size", limits.max_body, "body"), ("total_size", limits.max_total, "total"), ("header_size", limits.max_header, "header")):
        module = "headers" if component == "header" else "style"
        for kind, value in most.items():
            add((F.col("article_type") == kind) & (F.col(column) > value), X.size_code(F.col("article_type"), component))
    module = "headers"
    add(h("Subject").rlike(r"^Re: ") & ~has("References"), 11)
    module = "style"
    s, lines = F.col("line_stats"), F.col("line_stats")["lines"]
    if limits.max_line_length:
        add(~skip("style.line_statistics") & (s["longest"] > limits.max_line_length), 12)
    for name, most, code in (("quoted", limits.max_quoted_ratio, 13), ("blank", limits.max_blank_ratio, 14), ("empty", limits.max_empty_ratio, 15)):
        if most:
            add(~skip("style.line_statistics") & (lines > 0) & (s[name] / lines > most), code)
    if not limits.allow_html and limits.html_patterns:
        html = F.coalesce(F.col("body"), F.lit("")).rlike("(?is)" + "|".join(f"(?:{p})" for p in limits.html_patterns))
        exempt = joined.rlike("(?i)" + limits.html_groups) if limits.html_groups else F.lit(False)
        add(~skip("style.html") & html & ~exempt, 16)
    module = "groups"
    if not list_readable:
        add(F.lit(True), 37)
    if unknown_group is not None:
        add(unknown_group, 17)
    if unknown_followup is not None:
        add(unknown_followup, 18)
    if limits.max_hierarchies is not None:
        add(hierarchies(F.col("groups")) > limits.max_hierarchies, 25)
    if limits.max_hierarchies_followup is not None:
        add(hierarchies(F.col("followups")) > limits.max_hierarchies_followup, 26)
    if limits.forbidden_groups:
        closed = "(?i)" + "|".join(f"(?:{p})" for p in limits.forbidden_groups)
        add(F.exists(F.concat("groups", "followups"), lambda g: g.rlike(closed)), 54)
    module = "dates"
    when = rfc_epoch(h("Date"))
    add(when.isNull() | (when > F.col("received_s") + limits.future_grace_s), 19)
    if limits.too_old_s is not None:
        add(F.col("received_s") - when > limits.too_old_s, 58)
    module = "headers"
    if limits.max_header_length:
        add(F.exists(F.map_values("headers"), lambda v: F.length(v) > limits.max_header_length), 21)
    if not limits.allow_mail_headers:
        add(F.exists(F.map_keys("headers"), lambda k: F.lower(k).isin(*MAIL_HEADERS)), 22)
    add(has("In-Reply-To") & ~h("References").contains(h("In-Reply-To")), 24)
    if forbidden_header is not None:
        add(forbidden_header, 53)
    add(X.header(F.col("headers"), "Path").isNotNull() & (h("Path").rlike(r"[\r\n\x00]") | (F.trim(h("Path")) == "")), 20)
    code = F.lit(0)
    for condition, value in reversed(rules):
        code = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(code)
    return code


def unknown_groups(articles: DataFrame, active: DataFrame) -> DataFrame:
    """(article_id, unknown): the groups of each article that are not in the active list, sorted."""
    each = articles.select("article_id", F.explode(F.array_distinct("groups")).alias("group"))
    missing = each.join(active.select(F.col("group")).distinct(), "group", "left_anti")
    return missing.groupBy("article_id").agg(F.array_sort(F.collect_list("group")).alias("unknown"))


def known_group_flags(articles: DataFrame, active: DataFrame) -> DataFrame:
    """``articles`` with unknown_group and unknown_followup: whether a group of theirs is not in ``active(group)``; follow-ups to
    the poster or to junk need no group."""
    both = F.concat(F.transform("groups", lambda g: F.struct(g.alias("group"), F.lit(False).alias("followup"))), F.transform(F.array_except("followups", F.array(*map(F.lit, NO_GROUP))), lambda g: F.struct(g.alias("group"), F.lit(True).alias("followup"))))
    each = articles.select("article_id", F.inline(both)).distinct()
    missing = each.join(active.select("group").distinct(), "group", "left_anti")
    flags = missing.groupBy("article_id").agg(F.max(~F.col("followup")).alias("unknown_group"), F.max("followup").alias("unknown_followup"))
    return articles.join(flags, "article_id", "left").fillna(False, ["unknown_group", "unknown_followup"])


def forbidden_crossposts(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(article_id, ord): the first pair of patterns that an article's joined groups match on both sides."""
    many = articles.where(F.size("groups") > 1).select("article_id", F.array_join("groups", ",").alias("joined"))
    return many.join(small(pairs), F.expr("joined rlike concat('(?i)', left) AND joined rlike concat('(?i)', right)")).groupBy("article_id").agg(F.min("ord").alias("ord"))


def forbidden_header_names(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """(article_id, name, ord): headers whose name a rule forbids and no exception allows."""
    names = articles.select("article_id", F.explode(F.map_keys("headers")).alias("name"))
    return names.join(small(rules), F.expr("name rlike concat('(?i)', name_pattern) AND (exception_pattern IS NULL OR NOT name rlike concat('(?i)', exception_pattern))")).groupBy("article_id").agg(F.min(F.struct("ord", "name")).alias("x")).select("article_id", "x.name", "x.ord")
