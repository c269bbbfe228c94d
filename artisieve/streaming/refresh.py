"""Rules and reports that are brought up to date while streams run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from artisieve.operators.rules import MAX_RULES
from artisieve.sources.commits import CommitLog, stream_name

KINDS = ["regex", "contains", "exact", "cidr"]


def faults(rules: DataFrame) -> list[str]:
    """What keeps a rule table from use: too many rows, missing or repeated ids, unknown match types, patterns that do not
    compile. At most one fault a rule, by id."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        return [f"more than {MAX_RULES} rules"]
    compile_ = rules.sparkSession._jvm.java.util.regex.Pattern.compile
    out, seen = [], set()
    kind = F.coalesce("match_type", F.lit("regex")) if "match_type" in rules.columns else F.lit("regex")
    for r in rules.select("id", "pattern", kind.alias("kind")).orderBy("id").collect():  # configuration
        if r["id"] is None or r["id"] in seen:
            out.append(f"{r['id']}: no id, or one that is repeated")
        elif r["kind"] not in KINDS:
            out.append(f"{r['id']}: unknown match type {r['kind']}")
        elif r["kind"] == "regex" and r["pattern"] is not None:
            try:
                compile_(r["pattern"])
            except Exception:  # the JVM reports a syntax error of this pattern
                out.append(f"{r['id']}: pattern does not compile")
        seen.add(r["id"])
    return out


class RuleBook:
    """Versions of a rule table in a commit log. ``current`` looks for a new one at most every ``every_s`` seconds; a source that
    cannot be read or has faults leaves the last good version in force and its faults in the log."""

    def __init__(self, spark: SparkSession, root: str, load: Callable[[], DataFrame], every_s: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.log, self.load, self.every_s, self.clock = CommitLog(spark, root), load, every_s, clock
        self.looked: float | None = None
        self.held: tuple[int, DataFrame] | None = None

    def versions(self) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in self.log.names() if n.startswith("version-"))

    def current(self) -> tuple[int, DataFrame]:
        """(version, rules) in force. Without any good version there is an error."""
        if self.held is None or self.looked is None or self.clock() - self.looked >= self.every_s:
            self.refresh()
        if self.held is None:
            raise ValueError("no version of the rules is free of faults")
        return self.held

    def refresh(self) -> list[str]:
        """Takes over the source where it differs from the last version and has no faults; returns its faults."""
        self.looked = self.clock()
        known = self.versions()
        if known and (self.held is None or self.held[0] != known[-1]):
            self.held = known[-1], self._version(known[-1])
        try:
            rules = self.load()
            found = faults(rules)
        except PySparkException as e:
            found = [f"cannot be read: {str(e).splitlines()[0][:200]}"]
        number = (known[-1] if known else 0) + 1
        if found:
            when = self.log.spark.createDataFrame([(number, x) for x in found], "version int, fault string")
            self.log.commit(f"refused-{number}-{hash(tuple(found)) & 0xFFFFFFFF:x}", {"refused": when})
            return found
        if self.held is None or rules.columns != self.held[1].columns or rules.exceptAll(self.held[1]).limit(1).count() or self.held[1].exceptAll(rules).limit(1).count():
            self.log.commit(f"version-{number}", {f"rules-{number}": rules})
            self.held = number, self._version(number)
        return []

    def _version(self, number: int) -> DataFrame:
        return self.log.read(f"rules-{number}")


def refresh_report(events: DataFrame, report: Callable[[SparkSession], DataFrame], out: str, checkpoint: str, every: str = "10 minutes") -> DataStreamWriter:
    """Makes ``report`` anew in the commit log ``out`` each time that the timer ``every`` finds new rows of the stream ``events``: the log
    keeps each version, ``latest_report`` reads the last."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log, name = CommitLog(batch.sparkSession, out), stream_name(batch, batch_id)
        if not log.has(name):
            number = (log.fact("version") or 0) + 1
            log.commit(name, {f"report-{number}": report(batch.sparkSession)}, {"version": number})

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def latest_report(spark: SparkSession, out: str) -> DataFrame:
    log = CommitLog(spark, out)
    return log.read(f"report-{log.fact('version')}")
