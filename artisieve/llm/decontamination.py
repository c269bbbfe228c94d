"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders. Windows of template tokens, and of the words as
written, are hashed; a document's windows are hash-joined with the benchmark's. Along each diagonal of matching
windows the slots must be filled consistently: one benchmark value stands for one document value and the
reverse, so that a re-parameterised question is found and a chance mix of fillings is not. Where a diagonal
conflicts with itself, each longest consistent stretch of it counts if it has ``run`` tokens.

A bit table of fixed size, made of the benchmark's hashes, tells the readers of the documents which windows to send to
the join; a full table would only send more. Diagonals are read one after the other in sorted order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.llm.common import mix64, ngram_hashes, slices, staged, unused
from artisieve.llm.spans import bit_table, in_table

# Words that measure when they follow a number.
UNITS = frozenset(
    b"% cm mm m km mi mile miles ft foot feet inch inches yard yards g mg kg lb lbs oz ounce ounces pound pounds ton tons gram grams kilogram"
    b" kilograms meter meters metre metres kilometer kilometers kilometre kilometres l ml liter liters litre litres gallon gallons s sec second"
    b" seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur mph"
    b" kmh degree degrees percent watt watts volt volts joule joules newton newtons".split()
)
EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
NUMBER = re.compile(rb"[+-]?\d+(?:[.,:/]\d+)*")
MEASURE = re.compile(rb"([+-]?\d+(?:[.,]\d+)*)([a-z]+)")
IS_NUM, IS_UNIT, IS_CAPITAL, ENDS, ONE, TWO = 1, 2, 4, 8, 16, 32
PLACE = {k: int(mix64(np.array([k], np.uint64))[0]) for k in (IS_NUM, IS_UNIT, IS_CAPITAL)}


class Spelling(dict):
    """word as written -> one number: the hash of its lower-case core, with flags and the count of its tokens in the
    low byte. Bare punctuation has no token; a measure (12km) has two, kept in ``pairs``. ``trim`` empties both once
    there are ``bound`` words; within a text all of its words stay."""

    def __init__(self, bound: int = 600_000):
        self.bound = bound
        self.pairs: dict[bytes, list[int]] = {}

    def trim(self) -> None:
        if len(self) >= self.bound:
            self.clear()
            self.pairs.clear()

    def __missing__(self, word: bytes) -> int:
        core = word.strip(EDGE)
        low = core.lower()
        ends = ENDS if word.rstrip(b"\"')]*#$&%").endswith((b".", b"!", b"?")) else 0
        token = lambda part, flags: xxhash.xxh3_64_intdigest(part) >> 8 << 8 | ONE | flags
        if not core:
            out = 0
        elif NUMBER.fullmatch(low):
            out = token(low, IS_NUM | ends)
        elif (m := MEASURE.fullmatch(low)) and m[2] in UNITS:
            self.pairs[word] = [token(m[1], IS_NUM), token(m[2], IS_UNIT | ends)]
            out = TWO
        else:
            capital = core[:1].isupper() and core[1:].islower()
            out = token(low, (IS_UNIT if low in UNITS else 0) | (IS_CAPITAL if capital else 0) | ends)
        self[word] = out
        return out


@dataclass
class Template:
    """``tokens`` with placeholders; ``values`` as written; ``slot`` marks placeholders; ``word`` is each token's word."""

    tokens: np.ndarray
    values: np.ndarray
    slot: np.ndarray
    word: np.ndarray


def template(text: str | None, spelling: Spelling) -> Template:
    spelling.trim()
    words: list[bytes] = []
    starts: list[int] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        starts.append(len(words))
        words += line.split()
    packed = np.fromiter(map(spelling.__getitem__, words), np.uint64, len(words))
    word = np.arange(len(words))
    if (double := np.flatnonzero(packed == TWO)).size:
        pairs = np.array([spelling.pairs[words[i]] for i in double], np.uint64)
        packed, word = np.insert(packed, double + 1, pairs[:, 1]), np.insert(word, double + 1, double)
        packed[double + np.arange(len(double))] = pairs[:, 0]
    kept = packed & np.uint64(ONE) > 0
    packed, word = packed[kept], word[kept]
    f, v = (packed & np.uint64(15)).astype(np.int64), packed >> np.uint64(8)
    # A capital that opens a sentence or a line is no name.
    opens = np.zeros(len(f), bool)
    first = np.searchsorted(word, starts)
    opens[first[first < len(f)]] = True
    opens[1:] |= (f[:-1] & ENDS) > 0
    after_number = np.zeros(len(f), bool)
    after_number[1:] = (f[:-1] & IS_NUM) > 0
    unit, number, name = (f & IS_UNIT > 0) & after_number, f & IS_NUM > 0, (f & IS_CAPITAL > 0) & ~opens
    tokens = v.copy()
    for at, kind in ((name, IS_CAPITAL), (unit, IS_UNIT), (number, IS_NUM)):
        tokens[at] = np.uint64(PLACE[kind])
    return Template(tokens, v, unit | number | name, word)


def windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each window: of template tokens (of the words as written where most are placeholders), and of the words as written."""
    k = min(width, len(t.tokens))
    if not k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    literal, written = np.convolve(~t.slot, np.ones(k, np.int64), "valid"), ngram_hashes(t.values, k)
    return np.where(literal * 2 >= k, ngram_hashes(t.tokens, k), written), written


def stretches(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """The maximal ranges of slots in which the pairing of values is one to one."""
    left, ahead, back = 0, {}, {}
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        start = left
        for seen, key, other in ((ahead, x, y), (back, y, x)):
            if (last := seen.get(key)) and last[0] != other:
                start = max(start, last[1] + 1)
        if start > left:
            yield left, i
            left = start
        ahead[x], back[y] = (y, i), (x, i)
    yield left, len(a)


def both_windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each window, and of each window as written where that differs."""
    w, written = windows(t, width)
    other = np.flatnonzero(written != w)
    return np.concatenate([w, written[other]]), np.concatenate([np.arange(len(w)), other])


def cut_out(x: np.ndarray, places: np.ndarray, k: int) -> list[bytes]:
    """The ``k`` values from each place on."""
    return [r.tobytes() for r in x[places[:, None] + np.arange(k)]]


ITEM_WINDOWS = [("h", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("p", pa.int32()), ("item_values", pa.binary()), ("slots", pa.binary())]
DOC_WINDOWS = [("h", pa.int64()), ("k", pa.int32()), ("d", pa.int32()), ("values", pa.binary()), ("words", pa.binary())]


def window_rows(table: DataFrame, schema: list[tuple[str, pa.DataType]], find) -> DataFrame:
    """One row for each window that ``find(template)`` yields, with the columns of ``table`` but its last, the text."""
    kept = table.columns[:-1]
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling()
        for whole in batches:
            for b in slices(whole):
                at, out = [], []
                for i, text in enumerate(b.column(len(kept)).to_pylist()):
                    for cols in find(template(text, spelling)) if text else ():
                        at += [i] * len(cols[0])
                        out.append(cols)
                if at:
                    flat = [pa.array(np.concatenate([c[j] for c in out]) if isinstance(out[0][j], np.ndarray) else [x for c in out for x in c[j]], t) for j, (_, t) in enumerate(schema)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in range(len(kept))), *flat], [*kept, *(c for c, _ in schema)])

    kinds = dict(table.dtypes)
    return table.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} {names[t]}" for c, t in schema)]))


def evaluate(k: int, n: int, p: np.ndarray, item_values: np.ndarray, slots: np.ndarray, values: np.ndarray, words: np.ndarray, coverage: float, run: int) -> tuple | None:
    """(coverage, first word, end word, reparameterised) of the best consistent part of a diagonal: its windows' places in
    the item, and a row of ``k`` item values, slot marks, document values and words for each."""
    at, first = np.unique((p[:, None] + np.arange(k)).ravel(), return_index=True)
    if len(at) < coverage * n and len(at) < run:
        return None
    mine, slot, theirs, word = (x.ravel()[first] for x in (item_values, slots, values, words))
    slot, best = np.flatnonzero(slot), None
    for s, e in stretches(mine[slot], theirs[slot]):
        lo, hi = int(slot[s - 1]) + 1 if s else 0, int(slot[e]) if e < len(slot) else len(at)
        if (s, e) == (0, len(slot)) or hi - lo >= run:  # a part of a diagonal counts by its tokens only
            found = ((hi - lo) / n, int(word[lo]), int(word[hi - 1]) + 1, bool((mine[lo:hi] != theirs[lo:hi]).any()))
            best = found if best is None else max(best, found)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, run: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start_word, end_word, coverage, reparameterised): each benchmark item that a document holds.

    An item is held where consistent windows on one diagonal cover ``coverage`` of its tokens, or where a
    consistent stretch of a diagonal has ``run`` covered tokens. Null and empty texts on either side match nothing; repeated
    rows are reported each; items of one id count as one, by the best of them. Other columns are not read.
    """
    kinds = {"id": dict(docs.dtypes)[id_col], "item": dict(benchmark.dtypes)[item_col]}

    def of_items(t: Template) -> Iterator[tuple]:
        k = min(width, len(t.tokens))
        h, p = both_windows(t, width)
        if len(h):
            yield h.view(np.int64), np.full(len(h), k), np.full(len(h), len(t.tokens)), p, cut_out(t.values.view(np.int64), p, k), cut_out(t.slot, p, k)

    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(item_col, item_text_col).alias("version"), F.col(item_text_col).alias("text"))
    items = staged(window_rows(items, ITEM_WINDOWS, of_items).distinct(), "benchmark-windows")
    widths = sorted(r[0] for r in items.select("k").distinct().collect())  # at most ``width``
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(items.select("h")))

    def of_docs(t: Template) -> Iterator[tuple]:
        for k in widths:
            if len(t.tokens) >= k:
                h, d = both_windows(t, k)
                hit = in_table(shared.value, h)
                h, d = h[hit], d[hit]
                if len(h):
                    yield h.view(np.int64), np.full(len(h), k), d, cut_out(t.values.view(np.int64), d, k), cut_out(t.word.astype(np.int32), d, k)

    texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    found = window_rows(texts, DOC_WINDOWS, of_docs).join(items, ["h", "k"])
    order = ["row", "item", "version", "k", "shift", "p"]
    found = found.withColumn("shift", F.col("d") - F.col("p")).repartition("row").sortWithinPartitions(*order).select("id", "item", "row", "version", "k", "shift", "p", "n", "item_values", "slots", "values", "words")
    names = [id_col, item_col, "start_word", "end_word", "coverage", "reparameterised"]

    def diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        held: tuple | None = None  # (row, item), id and the best so far
        out: list[tuple] = []

        def read(b: pa.RecordBatch, cuts: list[int]) -> None:
            nonlocal held
            k, n, row = (b.column(c).to_numpy() for c in ("k", "n", "row"))
            p, ids, item = b.column("p").to_numpy(), b.column("id"), b.column("item")
            raw = [b.column(c).to_pylist() for c in ("item_values", "slots", "values", "words")]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if (e - s) * k[s] < min(coverage * n[s], run):
                    continue
                parts = (np.frombuffer(b"".join(c[s:e]), t).reshape(-1, k[s]) for c, t in zip(raw, (np.int64, bool, np.int64, np.int32), strict=True))
                best = evaluate(int(k[s]), int(n[s]), p[s:e], *parts, coverage, run)
                if best is None:
                    continue
                key = (int(row[s]), item[s].as_py())
                if held and held[0] == key:
                    held = (key, held[1], max(held[2], best))
                else:
                    if held:
                        out.append(held)
                    held = (key, ids[s].as_py(), best)

        def written(kind: pa.DataType, item_kind: pa.DataType) -> pa.RecordBatch:
            cols = zip(*((i, key[1], best[1], best[2], best[0], best[3]) for key, i, best in out), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, item_kind, pa.int32(), pa.int32(), pa.float64(), pa.bool_()), strict=True)], names)

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            last = b
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in ("row", "version", "k", "shift"):
                new[1:] |= np.diff(b.column(c).to_numpy()) != 0
            cuts = np.flatnonzero(new).tolist()
            read(b, cuts)  # all but the last diagonal, which may go on
            rest = b.slice(cuts[-1])
            if out:
                yield written(b.column("id").type, b.column("item").type)
                out.clear()
        if last is not None:
            read(rest, [0, rest.num_rows])
            if held:
                out.append(held)
            if out:
                yield written(last.column("id").type, last.column("item").type)

    return found.mapInArrow(diagonals, f"`{id_col}` {kinds['id']}, `{item_col}` {kinds['item']}, start_word int, end_word int, coverage double, reparameterised boolean")


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, run: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; null and empty texts stay."""
    key = unused(docs.columns, "key")
    keyed = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    held = leaks(keyed, benchmark, width, coverage, run, "key", "text", item_col, item_text_col).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(text_col)).join(staged(held, "leaked", keep=True), key, "left_anti").select(*docs.columns)
