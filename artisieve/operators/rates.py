"""Rate limits and duplicate posts: sliding windows over the event log.

Every counter ends before the current event, so one event never counts itself; events of equal time count those of
smaller id. Counters are taken in time buckets of a key (``trailing_sums``), so that a key which holds a third of the log is
spread over as many tasks as it has buckets. One shuffle by (key, bucket) serves all ten counters.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artisieve.functions.text import is_public_user

LONG_US, SHORT_US = 86_400_000_000, 600_000_000

# The metrics in the order in which they are checked, with the code of each identity kind.
METRICS = [
    ("max_articles", {"IP": 31, "DN": 32, "ID": 33}),
    ("max_short_articles", {"IP": 70, "DN": 71, "ID": 72}),
    ("max_total_errors", {"IP": 64, "DN": 65, "ID": 66}),
    ("max_short_errors", {"IP": 67, "DN": 68, "ID": 69}),
    ("max_short_size", {"IP": 73, "DN": 74, "ID": 75}),
    ("max_total_size", {"IP": 76, "DN": 77, "ID": 78}),
    ("max_short_groups", {"IP": 79, "DN": 80, "ID": 81}),
    ("max_total_groups", {"IP": 82, "DN": 83, "ID": 84}),
    ("max_short_followups", {"IP": 85, "DN": 86, "ID": 87}),
    ("max_total_followups", {"IP": 88, "DN": 89, "ID": 90}),
]
MULTIPOST = 30


def identity_list(server_type: str = "both", public_users: list[str] | None = None, public_pattern: str | None = None, domain_check: bool = False) -> Column:
    """The identities that an article is measured under, in order, as structs (kind, lookup, identity_ord).

    ``auth``: the user. ``both``: the user when named, else the address. Otherwise the address, and the domain if
    asked. Empty and null values are skipped.
    """
    user = F.coalesce(F.col("auth_user"), F.lit(""))
    public = is_public_user(user, public_users, public_pattern)
    by_user = F.lit(True) if server_type == "auth" else (~public if server_type == "both" else F.lit(False))
    entry = lambda kind, value, n: F.struct(F.lit(kind).alias("kind"), value.alias("lookup"), F.lit(n).alias("identity_ord"))
    address = [entry("IP", F.col("client_ip"), 0)]
    if domain_check:
        address.append(entry("DN", F.col("client_domain"), 1))
    many = F.when(by_user, F.array(entry("ID", user, 0))).otherwise(F.array(*address))
    return F.filter(many, lambda x: x["lookup"].isNotNull() & (x["lookup"] != ""))


def identities(events: DataFrame, **options: object) -> DataFrame:
    """One row for each identity that an article is measured under (``identity_list``): adds kind, lookup and identity_ord."""
    return events.withColumn("__i", F.explode(identity_list(**options))).select(*events.columns, "__i.*")


def _frames(keys: list[str], period: int):
    w = Window.partitionBy(*keys).orderBy("received_us")
    tie = Window.partitionBy(*keys, "received_us").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return w.rangeBetween(-period, -1), tie


def trailing(value: Column, keys: list[str], period: int) -> Column:
    """Sum of ``value`` over earlier events of the keys, at most ``period`` microseconds ago."""
    frame, tie = _frames(keys, period)
    zero = F.lit(0).cast("long")
    return F.coalesce(F.sum(value).over(frame), zero) + F.coalesce(F.sum(value).over(tie), zero)


def bucket_width(periods: list[int]) -> int:
    """A width that divides all periods, the longest into a hundred buckets or more where that is possible."""
    common = math.gcd(*periods)
    more = next(f for f in (144, 100, 96, 60, 48, 24, 10, 6, 4, 2, 1) if common % f == 0)
    return common if max(periods) >= 100 * common else common // more


def trailing_sums(rows: DataFrame, keys: list[str], counters: dict[str, tuple[Column, int]]) -> DataFrame:
    """Adds counters to ``rows``: the sum of a value over earlier events of the keys, at most its period of microseconds ago.

    Time falls into buckets that divide every period. What an event counts is then the whole buckets of its period (a
    range frame over bucket totals, of which a key has as many as the log has time), less the part of the oldest bucket that
    is too old, plus the part of its own that is earlier. Both parts are running sums inside a (keys, bucket) group: of
    its own rows, and of halo rows lent to it by the bucket one period before. Null keys are a key.
    """
    width = bucket_width([period for _, period in counters.values()])
    names, zero = list(counters), F.lit(0).cast("long")
    place = F.struct(*[F.col(c) for c in rows.columns]).alias("__row")
    value = [F.coalesce(counters[c][0].cast("long"), zero).alias(c) for c in names]
    offset = F.pmod("received_us", F.lit(width))
    bucket = F.expr(f"(received_us - pmod(received_us, {width}L)) div {width}L")
    key = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    by = [f"__k{i}" for i in range(len(keys))]
    own = rows.select(*key, bucket.alias("__bucket"), offset.alias("__offset"), F.lit(0).alias("__role"), F.col("id").alias("__id"), *(v.alias(f"__v_{c}") for v, c in zip(value, names, strict=True)), place)
    none = {"__row": F.lit(None).cast(own.schema["__row"].dataType), "__id": F.lit(None).cast(own.schema["__id"].dataType)}
    totals = own.groupBy(*by, "__bucket").agg(*(F.sum(f"__v_{c}").alias(f"__v_{c}") for c in names))
    frame = Window.partitionBy(*by).orderBy("__bucket")
    whole = totals.withColumns({f"__v_{c}": F.coalesce(F.sum(f"__v_{c}").over(frame.rangeBetween(-(counters[c][1] // width), -1)), zero) for c in names})
    parts = [own, whole.withColumns({"__offset": F.lit(-1).cast("long"), "__role": F.lit(-1), **none}).select(*own.columns)]
    for period in sorted({p for _, p in counters.values()}):
        lent = {f"__v_{c}": -F.col(f"__v_{c}") if counters[c][1] == period else zero for c in names}
        parts.append(own.withColumns({"__bucket": F.col("__bucket") + period // width, "__role": F.lit(1), **lent, **none}))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    before = Window.partitionBy(*by, "__bucket").orderBy("__offset", "__role", "__id").rowsBetween(Window.unboundedPreceding, -1)
    summed = every.withColumns({f"__v_{c}": F.coalesce(F.sum(f"__v_{c}").over(before), zero) for c in names})
    return summed.where("__role = 0").select("__row.*", *(F.col(f"__v_{c}").alias(c) for c in names))


def rate_snapshot(rows: DataFrame, by_type: bool = False, long_us: int = LONG_US, short_us: int = SHORT_US) -> DataFrame:
    """Adds the ten counters to rows that carry (kind, lookup): accepted articles, rejects, and the bytes, groups and
    follow-ups of every event, over the long and the short period. ``by_type`` counts each article type apart."""
    keys = ["kind", "lookup", *(["article_type"] if by_type else [])]
    accepted = F.when(F.col("nntp_result") == "accepted", 1).otherwise(0)
    rejected = F.when(F.col("technical_verdict") == "reject", 1).otherwise(0)
    counters = {}
    for value, long_name, short_name in ((accepted, "max_articles", "max_short_articles"), (rejected, "max_total_errors", "max_short_errors"), (F.col("total_size"), "max_total_size", "max_short_size"), (F.col("group_count"), "max_total_groups", "max_short_groups"), (F.col("followup_count"), "max_total_followups", "max_short_followups")):
        counters[long_name], counters[short_name] = (value, long_us), (value, short_us)
    return trailing_sums(rows, keys, counters)


def multipost_count(events: DataFrame, by_type: bool = False, period_us: int = LONG_US) -> DataFrame:
    """Adds ``multipost``: accepted earlier events with the same digest in the period."""
    keys = ["article_digest", *(["article_type"] if by_type else [])]
    return trailing_sums(events, keys, {"multipost": (F.when(F.col("nntp_result") == "accepted", 1).otherwise(0), period_us)})


def rate_violations(snapshot: DataFrame, limits: dict[str, dict[str, int]] | DataFrame, absolute_multipost: int = 0, default_multipost: int = 2) -> DataFrame:
    """One row for each event over a limit: (id, legacy_code, metric), the first in check order.

    ``snapshot`` has the ten counters and ``multipost``. ``limits`` maps an identity kind to its metrics' limits, or
    is a table (kind, lookup, limits map<string,long>). An absent metric has no limit. The event itself counts: one
    article, no error, its own size, groups and follow-ups.
    """
    if isinstance(limits, DataFrame):
        rows = snapshot.join(limits, ["kind", "lookup"], "left")
        limit = lambda name: F.col("limits")[name]
    else:
        rows = snapshot

        def limit(name: str) -> Column:
            out = F.lit(None).cast("long")
            for kind, values in limits.items():
                if name in values:
                    out = F.when(F.col("kind") == kind, F.lit(values[name]).cast("long")).otherwise(out)
            return out

    own = {"articles": F.lit(1), "errors": F.lit(0), "size": F.col("total_size"), "groups": F.col("group_count"), "followups": F.col("followup_count")}
    multi = F.coalesce(limit("multipost"), F.lit(default_multipost).cast("long"))
    found = [
        F.when((F.lit(absolute_multipost) > 0) & (F.col("multipost") >= absolute_multipost), F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("m"), F.lit(MULTIPOST).alias("legacy_code"), F.lit("absolute_multipost").alias("metric"))),
        F.when((multi > 0) & (F.col("multipost") >= multi), F.struct(F.col("identity_ord").alias("i"), F.lit(-1).alias("m"), F.lit(MULTIPOST).alias("legacy_code"), F.lit("multipost").alias("metric"))),
    ]
    for n, (name, codes) in enumerate(METRICS):
        code = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c)) for k, c in codes.items()])
        over = F.col(name) + own[name.rsplit("_", 1)[1]] > limit(name)
        found.append(F.when(over, F.struct(F.col("identity_ord").alias("i"), F.lit(n).alias("m"), code.alias("legacy_code"), F.lit(name).alias("metric"))))
    first = rows.select("id", F.coalesce(*found).alias("v")).where("v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    return first.select("id", "v.legacy_code", "v.metric")


class Trail:
    """Running sums of a key's events over one period: articles accepted, errors, bytes, groups, follow-ups."""

    def __init__(self, period: int):
        self.period, self.held, self.sums = period, deque(), [0] * 5

    def at(self, now: int) -> list[int]:
        while self.held and self.held[0][0] < now - self.period:
            for i, x in enumerate(self.held.popleft()[1]):
                self.sums[i] -= x
        return self.sums

    def add(self, now: int, values: tuple[int, ...]) -> None:
        self.held.append((now, values))
        for i, x in enumerate(values):
            self.sums[i] += x


class Ledger:
    """The outcomes of one group's events, given in time order."""

    def __init__(self, limits: dict[str, dict[str, int]], absolute_multipost: int, default_multipost: int, long_us: int, short_us: int):
        self.limits, self.absolute, self.default, self.periods = limits, absolute_multipost, default_multipost, (long_us, short_us)
        self.trails: dict[int, tuple[Trail, Trail]] = {}
        self.digests: dict[int, Trail] = {}
        order = ["articles", "errors", "size", "groups", "followups"]
        self.metrics = [(name, order.index(name.rsplit("_", 1)[1]), "short" in name, codes) for name, codes in METRICS]

    def code(self, now: int, keys: list[int], kinds: list[str], multipost: int, own: tuple) -> int:
        """The code of the first limit passed, 0 for none: an absolute repeat, then by identity a repeat and the metrics in order."""
        if keys and 0 < self.absolute <= multipost:
            return MULTIPOST
        for key, kind in zip(keys, kinds, strict=True):
            limits = self.limits.get(kind, {})
            if 0 < limits.get("multipost", self.default) <= multipost:
                return MULTIPOST
            sums = [trail.at(now) for trail in self.trails[key]] if key in self.trails else [[0] * 5] * 2
            for name, value, short, codes in self.metrics:
                limit = limits.get(name)
                if limit is not None and own[value] is not None and sums[short][value] + own[value] > limit:
                    return codes[kind]
        return 0

    def event(self, now: int, bad: bool, keys: list[int], kinds: list[str], digest: int | None, size: int | None, groups: int | None, followups: int | None) -> int:
        seen = self.digests[digest].at(now)[0] if digest in self.digests else 0
        code = 0 if bad else self.code(now, keys, kinds, seen, (1, 0, size, groups, followups))
        rejected = int(bad or code > 0)
        values = (1 - rejected, rejected, size or 0, groups or 0, followups or 0)
        for key in keys:
            if key not in self.trails:
                self.trails[key] = tuple(map(Trail, self.periods))
            for trail in self.trails[key]:
                trail.at(now)
                trail.add(now, values)
        if digest is not None:
            self.digests.setdefault(digest, Trail(self.periods[0])).at(now)
            self.digests[digest].add(now, values)
        return code


def enforce_outcomes(events: DataFrame, limits: dict[str, dict[str, int]], absolute_multipost: int = 0, default_multipost: int = 2, long_us: int = LONG_US, short_us: int = SHORT_US, **identity_options: object) -> DataFrame:
    """(id, legacy_code) of the events that rate limits reject when a rejection is not counted as accepted.

    An outcome changes later counters only, of its identities and of its digest. So events fall into groups that do not
    touch: keys connected by shared events, cut wherever a group rests for longer than the longest period. A digest connects
    only where it is held often enough for its limit. Each group is one pass in (time, id) order, read as a stream of sorted
    rows: a task holds the windows of the group at hand, not its events. Groups of one identity that never rests are one task's
    work, as each outcome needs the one before. Null sizes and counts pass no limit; events without identity are never
    rejected, but count for their digest.
    """
    from artisieve.operators.groups import connected
    from artisieve.sources.staging import staged

    # Absent columns of identities are null.
    for c in ("auth_user", "client_ip", "client_domain"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    repeats = [n for n in (absolute_multipost, default_multipost, *(k["multipost"] for k in limits.values() if "multipost" in k)) if n > 0]
    if absolute_multipost <= 0 and {"ID", "IP", "DN"} <= {k for k, v in limits.items() if v.get("multipost", default_multipost) <= 0}:
        repeats = []
    who = identity_list(**identity_options)
    base = events.select("id", "received_us", (F.col("technical_verdict") == "reject").alias("bad"), *(F.col(c).cast("long").alias(c) for c in ("total_size", "group_count", "followup_count")), who.alias("who"), F.xxhash64(F.lit("digest"), "article_digest").alias("digest"))
    base = base.withColumns({"keys": F.transform("who", lambda w: F.xxhash64(w["kind"], w["lookup"])), "kinds": F.col("who.kind"), "bad": F.coalesce("bad", F.lit(False))}).drop("who")
    if repeats:
        often = base.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > min(repeats)).select("digest", F.col("digest").alias("live"))
        base = base.join(often, "digest", "left").drop("digest").withColumnRenamed("live", "digest")
    else:
        base = base.withColumn("digest", F.lit(None).cast("long"))
    nodes = F.array_compact(F.concat("keys", F.array("digest")))
    base = staged(base.withColumn("nodes", nodes).where(F.size("nodes") > 0), "enforce-events")

    links = base.where(F.size("nodes") > 1).select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b"))
    if links.limit(1).count():
        labels = connected(links).select(F.col("v").alias("node"), "label")
        grouped = base.withColumn("node", F.col("nodes")[0]).join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("node", "label", "nodes")
    else:
        grouped = base.withColumn("group", F.col("nodes")[0]).drop("nodes")
    width = max(long_us, short_us)
    grouped = grouped.withColumn("bucket", F.expr(f"(received_us - pmod(received_us, {width}L)) div {width}L"))
    along = Window.partitionBy("group").orderBy("bucket")
    begins = F.coalesce((F.col("bucket") - F.lag("bucket").over(along) > 1).cast("int"), F.lit(1))
    runs = grouped.select("group", "bucket").distinct().withColumn("begins", begins).withColumn("run", F.sum("begins").over(along)).drop("begins")
    rows = grouped.join(runs, ["group", "bucket"]).select(F.xxhash64("group", "run").alias("group"), "id", "received_us", "bad", "keys", "kinds", "digest", "total_size", "group_count", "followup_count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = ledger = None
        for b in batches:
            codes = []
            for g, *event in zip(*(b.column(i).to_pylist() for i in (0, *range(2, b.num_columns))), strict=True):
                if g != group:
                    group, ledger = g, Ledger(limits, absolute_multipost, default_multipost, long_us, short_us)
                codes.append(ledger.event(*event))
            codes = pa.array(codes, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1), codes], ["id", "legacy_code"]).filter(pa.compute.greater(codes, 0))

    kind = dict(events.dtypes)["id"]
    return staged(rows.repartition("group").sortWithinPartitions("group", "received_us", "id").mapInArrow(run, f"id {kind}, legacy_code int"), "enforced")
