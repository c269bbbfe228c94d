"""Streams with state by key: local marks passed down threads, and a cache of lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MARKS = "ids array<string>, local array<boolean>, ok array<boolean>, ord array<long>, at array<long>"


def thread_stream(posts: DataFrame, allowed: tuple[str, ...] = ("local", "usenet"), keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """(message_id, local, legacy_code) for a stream of (root, message_id, parent_id, distribution, accepted, ord): the rows of
    ``threads.local_threads``, where posts of a thread arrive in order. ``root`` is the first message of the thread (its first
    reference, else the post itself).

    State is a thread's marks by message id. A mark is dropped ``keep_ms`` after it was written, at the thread's next batch, and
    a thread that rests for so long as a whole.
    """

    def step(key: tuple, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        marks = {i: rest for i, *rest in zip(*state.get, strict=True) if now - rest[3] <= keep_ms} if state.exists else {}
        out = []
        for p in pd.concat(list(pages)).sort_values(["ord", "message_id"]).itertuples():
            value = ("" if pd.isna(p.distribution) else p.distribution).strip().lower()
            bad = value != "" and value not in allowed
            local = value == "local"
            if value == "" and p.parent_id in marks:
                parent_local, parent_ok, parent_ord, _ = marks[p.parent_id]
                local = bool(parent_local and parent_ok and parent_ord < p.ord)
            marks[p.message_id] = [local, bool(p.accepted) and not bad, int(p.ord), now]
            out.append((p.message_id, local, 108 if bad else 0))
        state.update((list(marks), *(list(x) for x in zip(*marks.values(), strict=True))))
        state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["message_id", "local", "legacy_code"])

    return posts.groupBy("root").applyInPandasWithState(step, "message_id string, local boolean, legacy_code int", MARKS, "append", "ProcessingTimeTimeout")


def lookup_stream(requests: DataFrame, positive_us: int = 3_600_000_000, negative_us: int = 300_000_000, keep_ms: int = 86_400_000) -> DataFrame:
    """(id, cached) for a stream of requests (provider, key, ts_us, id, listed), as ``reputation.lookup_dedupe`` has it; requests of a
    key arrive in order. A key's state is its last request, dropped ``keep_ms`` after it came."""
    life = {True: positive_us, False: negative_us}
    kind = dict(requests.dtypes)["id"]

    def step(key: tuple, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        out = []
        for r in pd.concat(list(pages)).sort_values(["ts_us", "id"]).itertuples():
            out.append((r.id, before is not None and r.ts_us - before[0] < life[bool(before[1])]))
            before = (int(r.ts_us), bool(r.listed))
        state.update(before)
        state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["id", "cached"])

    return requests.groupBy("provider", "key").applyInPandasWithState(step, f"id {kind}, cached boolean", "ts_us long, listed boolean", "append", "ProcessingTimeTimeout")
