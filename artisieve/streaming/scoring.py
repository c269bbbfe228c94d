"""Structured Streaming over the same column functions: scoring, trailing counters, reports and provider health."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from artisieve.operators.rates import LONG_US, SHORT_US
from artisieve.sources.articles import record_batch
from artisieve.sources.commits import CommitLog, stream_name


def score_stream(articles: DataFrame, score: Callable[[DataFrame], tuple[DataFrame, ...]], out: str, checkpoint: str) -> DataStreamWriter:
    """Scores each micro-batch with ``score(batch) -> (events, hits)`` or ``(events, hits, saved)`` and records all of them in the commit log
    ``out`` under the stream's and the batch's name. Rule tables that ``score`` reads are read anew for each batch
    (``refresh.RuleBook`` keeps the last good version), so that a change takes effect without a restart."""

    def write(batch: DataFrame, batch_id: int) -> None:
        name = stream_name(batch, batch_id)
        if not CommitLog(batch.sparkSession, out).has(name):
            events, hits, *saved = score(batch)
            record_batch(events, hits, out, name, *saved)

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def earlier_sums(times: np.ndarray, weights: np.ndarray, new_times: np.ndarray, new_weights: np.ndarray, period: int) -> np.ndarray:
    """For each new event the summed weights of the events before it, held or new, of the last ``period``; all in time order."""
    total = lambda w: np.concatenate([[0], np.cumsum(w)])
    held, mine = total(weights), total(new_weights)
    since = new_times - period
    return held[-1] - held[np.searchsorted(times, since)] + mine[: len(new_times)] - mine[np.searchsorted(new_times, since)]


def trailing_state(events: DataFrame, keys: list[str], measures: dict[str, str], counters: dict[str, tuple[str, int]], late: str) -> DataFrame:
    """(keys, id, counters): sums over the earlier events of the key, for a stream with ``keys``, id, received_us and ts.

    ``measures`` are SQL expressions; a counter is a measure and a period. State is the key's events of the longest
    period, as arrays in time order; it expires with the watermark. Within a batch, events count in (time, id) order.
    """
    longest = max(period for _, period in counters.values())
    names = list(measures)

    def step(key: tuple, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, *held = (np.array(x, np.int64) for x in (state.get if state.exists else [[] for _ in range(len(names) + 1)]))
        new = pd.concat(list(pages)).sort_values(["received_us", "id"])
        t = new["received_us"].to_numpy(np.int64)
        fresh = [new[m].to_numpy(np.int64) for m in names]
        sums = {c: earlier_sums(times, held[names.index(m)], t, fresh[names.index(m)], period) for c, (m, period) in counters.items()}
        every = np.concatenate([times, t])
        order = np.argsort(every, kind="stable")
        order = order[every[order] >= t[-1] - longest]
        state.update(tuple(np.concatenate(x)[order].tolist() for x in ((times, t), *zip(held, fresh, strict=True))))
        state.setTimeoutTimestamp(max(int(every.max()) // 1000 + longest // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "id": new["id"].to_numpy(), **sums})

    kinds = dict(events.dtypes)
    read = events.select(*keys, "id", "received_us", "ts", *(F.expr(x).cast("long").alias(m) for m, x in measures.items()))
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"id {kinds['id']}", *(f"{c} long" for c in counters)])
    state = ", ".join(f"{x} array<long>" for x in ("times", *names))
    return read.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(step, out, state, "append", "EventTimeTimeout")


def trailing_counts(events: DataFrame, long_us: int = LONG_US, short_us: int = SHORT_US, late: str = "1 hour") -> DataFrame:
    """(lookup, id, long_count, short_count, long_bytes) for a stream of (lookup, id, received_us, ts, total_size)."""
    counters = {"long_count": ("one", long_us), "short_count": ("one", short_us), "long_bytes": ("size", long_us)}
    return trailing_state(events, ["lookup"], {"one": "1", "size": "total_size"}, counters, late)


def rate_stream(events: DataFrame, long_us: int = LONG_US, short_us: int = SHORT_US, late: str = "1 hour") -> DataFrame:
    """(kind, lookup, id) and the ten counters of ``rates.rate_snapshot``, for a stream of identities' events."""
    measures = {"articles": "int(nntp_result <=> 'accepted')", "errors": "int(technical_verdict <=> 'reject')", "size": "coalesce(total_size, 0)", "groups": "coalesce(group_count, 0)", "followups": "coalesce(followup_count, 0)"}
    counters = {}
    for m in measures:
        counters["max_articles" if m == "articles" else f"max_total_{m}"] = (m, long_us)
        counters[f"max_short_{m}"] = (m, short_us)
    return trailing_state(events, ["kind", "lookup"], measures, counters, late)


def multipost_stream(events: DataFrame, period_us: int = LONG_US, late: str = "1 hour") -> DataFrame:
    """(article_digest, id, multipost): accepted earlier events of the digest in the period."""
    return trailing_state(events, ["article_digest"], {"accepted": "int(nntp_result <=> 'accepted')"}, {"multipost": ("accepted", period_us)}, late)


def hourly_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Activity by hour for a stream of (ts, nntp_result)."""
    flag = lambda name: F.sum(F.when(F.col("nntp_result") == name, 1).otherwise(0)).alias(name)
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("total"), flag("accepted"), flag("rejected")).select(F.col("window.start").alias("hour"), "total", "accepted", "rejected")


def dedupe_lookups(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of lookup requests (provider, key, ts) without those that repeat one within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["provider", "key"])


def health_stream(log: DataFrame, threshold: int = 5, cooldown_us: int = 300_000_000) -> DataFrame:
    """(provider, id, failures, suppressed) for a stream of lookups (provider, id, ts_us, ok)."""

    def step(key: tuple, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, struck = state.get if state.exists else (0, None)
        out = []
        for e in pd.concat(list(pages)).sort_values(["ts_us", "id"]).itertuples():
            suppressed = struck is not None and e.ts_us - struck < cooldown_us
            failures = 0 if e.ok else failures + 1
            if failures >= threshold:
                struck = int(e.ts_us)
            out.append((key[0], e.id, failures, suppressed))
        state.update((failures, struck))
        yield pd.DataFrame(out, columns=["provider", "id", "failures", "suppressed"])

    return log.groupBy("provider").applyInPandasWithState(step, "provider string, id long, failures long, suppressed boolean", "failures long, struck long", "append", "NoTimeout")
