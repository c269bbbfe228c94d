"""Repeated passages by sparse suffix arrays.

Each window of ``min_words`` words keeps one suffix: the one that starts at the least (minimiser) of its
``width``-word hashes, a choice that depends on the window's words alone. Windows that are equal therefore keep
equal suffixes, at one distance. Suffixes whose first ``width`` words one document alone holds are left out. The
others are sorted and scanned: among neighbours that share the first ``width`` words, each window is matched with the
first neighbour that holds it too. A long run of neighbours is split between tasks, and what each sees of it is
matched once more across them. Each match is then extended word by word both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.llm.common import ngram_hashes, scratch, shuffles_released, slices, sliding, staged
from artisieve.llm.spans import bit_table, both_sides, found_rows, in_table, keyed, shared_hashes, window_starts

#: Neighbours that are compared at once; a longer run of equal suffixes is split, and its pieces are matched across.
RUN = 50_000
#: Long runs that are split; others hold less than one in ``HEAVY`` of all suffixes and are cut within a task.
HEAVY = 1 << 20


def kept_suffixes(words: np.ndarray, ends: np.ndarray, width: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, place, hash): each window of ``min_words`` words of one text, with its suffix's place and first hash."""
    starts = np.flatnonzero(window_starts(words, ends, min_words))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    h, low = ngram_hashes(words, width), np.uint64((1 << 24) - 1)
    tagged = h & ~low | np.arange(len(h), dtype=np.uint64) & low  # leftmost of equal hashes
    least = sliding(tagged, min_words - width + 1, np.minimum)[starts]
    p = starts + ((least - starts.astype(np.uint64)) & low).astype(np.int64)
    return starts, p, h[p]


def runs_of(p: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.diff(p, prepend=-1))


def neighbours(suffixes: DataFrame, long_runs: DataFrame) -> DataFrame:
    """(a, a_id, b, b_id, shift, lo, hi) of ``suffixes(h, row, id, s, windows)``: windows lo to hi of a are those of b at ``shift``.
    ``long_runs(h, parts)`` are dealt to so many tasks; their windows are matched across by a key each."""
    kind = dict(suffixes.dtypes)["id"]
    names = ["a", "a_id", "b", "b_id", "shift", "lo", "hi", "key"]

    def compare(x: pa.RecordBatch, partial: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, s0, raw = x.column("row").to_numpy(), x.column("s").to_numpy(), x.column("windows").to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        of = np.repeat(np.arange(len(row)), size)
        s = s0[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        key = np.frombuffer(b"".join(raw), np.int64)
        order = np.lexsort((s, row[of], key))
        of, s, key = of[order], s[order], key[order]
        first = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
        last, group = np.append(first[1:], len(key)) - 1, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        own = np.ones(len(key), bool)  # where a document's places begin among those of a key
        own[1:] = (np.diff(key) != 0) | (np.diff(of_row := row[of]) != 0)
        starts = np.flatnonzero(own)
        count = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
        begins = np.repeat(starts, count[starts])
        mate = first[group]
        mate = np.where(of_row[mate] == of_row, begins[last[group]], mate)
        mate = mate + (np.arange(len(key)) - begins) % count[mate]  # repeats within documents are paired in order
        linked = row[of[mate]] != row[of]
        a, b, lo, shift = of[linked], of[mate[linked]], s[linked], s[mate[linked]] - s[linked]
        order = np.lexsort((lo, shift, b, a))
        a, b, lo, shift = a[order], b[order], lo[order], shift[order]
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(shift) != 0)
        at = np.flatnonzero(new)
        hi = lo[np.append(at[1:], len(a)) - 1] if len(at) else lo
        take = lambda c, i: x.column(c).take(pa.array(i))
        ints = lambda v: pa.array(v, pa.int32())
        if len(at):
            yield pa.RecordBatch.from_arrays([take("row", a[at]), take("id", a[at]), take("row", b[at]), take("id", b[at]), ints(shift[at]), ints(lo[at]), ints(hi), pa.nulls(len(at), pa.int64())], names)
        ask = np.zeros(len(of), bool)
        ask[first] = ask[last] = True
        ask = np.flatnonzero((ask | ~linked) & partial[of])
        if len(ask):
            n, at = len(ask), of[ask]
            yield pa.RecordBatch.from_arrays([take("row", at), take("id", at), pa.nulls(n, pa.int64()), pa.nulls(n, x.column("id").type), pa.nulls(n, pa.int32()), ints(s[ask]), pa.nulls(n, pa.int32()), pa.array(key[ask])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, cut_run = None, None  # the last run so far; the last run that was cut
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            h, part = b.column("h").to_numpy(), b.column("parts").to_numpy() > 1
            part |= (h == cut_run) if cut_run is not None else False
            start = int(np.searchsorted(h, h[-1]))
            if len(h) - start > RUN:
                yield from compare(b, part | (h == h[-1]))
                rest, cut_run = None, h[-1]
            else:
                if start:
                    yield from compare(b.slice(0, start), part[:start])
                rest = b.slice(start)
        if rest is not None:
            yield from compare(rest, (rest.column("parts").to_numpy() > 1) | (rest.column("h")[0].as_py() == cut_run))

    rows = suffixes.join(F.broadcast(long_runs), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # at most HEAVY rows
    rows = rows.withColumn("part", F.pmod("row", F.col("parts"))).repartition("h", "part").sortWithinPartitions("h", "row", "s").select("h", "row", "id", "s", "windows", "parts")
    found = staged(rows.mapInArrow(run, f"a long, a_id {kind}, b long, b_id {kind}, shift int, lo int, hi int, key long"), "suffix-neighbours")
    asked = found.where("key IS NOT NULL").select("key", F.struct(F.col("a").alias("row"), F.col("a_id").alias("id"), F.col("lo").alias("s")).alias("x"))
    ends = asked.groupBy("key").agg(F.min("x").alias("first"), F.max("x").alias("last")).where("first.row <> last.row")
    across = asked.join(ends, "key").select("x", F.when(F.col("first.row") != F.col("x.row"), F.col("first")).otherwise(F.col("last")).alias("y"))
    return found.where("key IS NULL").drop("key").unionByName(across.select(F.col("x.row").alias("a"), F.col("x.id").alias("a_id"), F.col("y.row").alias("b"), F.col("y.id").alias("b_id"), (F.col("y.s") - F.col("x.s")).alias("shift"), F.col("x.s").alias("lo"), F.col("x.s").alias("hi")))


def equal_runs(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal runs [start, end) of at least ``least`` places where two aligned arrays agree."""
    eq = np.concatenate([[0], (a == b).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(eq))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s >= least]


def repeated_passages(docs: DataFrame, min_words: int = 50, width: int = 36, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, partner_id, partner_start): passages of ``min_words`` or more that two documents share.

    Words are lower-cased (A-Z). Each window of ``min_words`` words that another document holds too lies in a row of its
    document: copies form stars, not all pairs, and a pair has a row for either side. A passage is as long as both
    agree, up to ``min_words`` words beyond the windows matched with this partner. Null ids and texts take no part;
    rows of one id and text count once; repeats within one document are not reported. The result is staged.
    """
    with scratch(docs.sparkSession), shuffles_released(docs.sparkSession):
        source = keyed(docs, id_col, text_col)

        def first_hashes(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, p, h = kept_suffixes(words, ends, width, min_words)
            at = runs_of(p)
            return np.searchsorted(ends, p[at], side="right") - 1, h[at]

        common = staged(shared_hashes(source, first_hashes), "shared-suffixes")
        long_runs = common.where(F.col("n") > RUN).orderBy(F.desc("n"), "h").limit(HEAVY).select("h", F.ceil(F.col("n") / RUN).cast("int").alias("parts"))
        shared = source.sparkSession.sparkContext.broadcast(bit_table(common))

        def suffixes(words: np.ndarray, ends: np.ndarray) -> tuple:
            s, p, h = kept_suffixes(words, ends, width, min_words)
            ok = in_table(shared.value, h)
            s, p, h = s[ok], p[ok], h[ok]
            at = runs_of(p)
            doc = np.searchsorted(ends, s[at], side="right") - 1
            cuts = (np.append(at, len(s)) * 8).astype(np.int32)
            windows = ngram_hashes(words, min_words)[s] if len(s) else np.zeros(0, np.uint64)
            raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(windows.tobytes())])
            return doc, h[at].view(np.int64), s[at] - ends[doc], raw

        rows = found_rows(source, suffixes, {"h": pa.int64(), "s": pa.int32(), "windows": pa.binary()})
        diagonals = neighbours(rows, long_runs).groupBy("a", "b", "shift").agg(F.min("a_id").alias("a_id"), F.min("b_id").alias("b_id"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        lo, hi = F.col("lo") - min_words, F.col("hi") + 2 * min_words
        asked = staged(diagonals.select("a", "a_id", lo.alias("a_lo"), hi.alias("a_hi"), "b", "b_id", (lo + F.col("shift")).alias("b_lo"), (hi + F.col("shift")).alias("b_hi"), "shift"), "suffix-diagonals")
        kind = dict(docs.dtypes)[id_col]

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    out, at = [], []
                    for i, (shift, a0, a, b0, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shift", "a_base", "a_words", "b_base", "b_words")), strict=True)):
                        a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                        first = max(a0, b0 - shift)
                        a, b = a[first - a0 :], b[first + shift - b0 :]
                        n = min(len(a), len(b))
                        for s, e in equal_runs(a[:n], b[:n], min_words):
                            out.append((first + s, first + e, first + s + shift, first + e + shift))
                            at.append(i)
                    if out:
                        s, e, p, q = (pa.array(c, pa.int32()) for c in zip(*out, strict=True))
                        a_id, b_id = (batch.column(c).take(pa.array(at)) for c in ("a_id", "b_id"))
                        for columns in ((a_id, s, e, b_id, p), (b_id, p, q, a_id, s)):
                            yield pa.RecordBatch.from_arrays([*columns], [id_col, "start_word", "end_word", "partner_id", "partner_start"])

        cols = ["a_id", "b_id", "shift", "a_base", "a_words", "b_base", "b_words"]
        found = both_sides(source, asked).select(*cols).mapInArrow(extend, f"`{id_col}` {kind}, start_word int, end_word int, partner_id {kind}, partner_start int")
        return staged(found, "repeated-passages", keep=True)
