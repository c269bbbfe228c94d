"""Packing of tokenised documents into fixed windows by non-negative least squares.

1. One pass tokenises each document, cuts whole windows off its front and keeps the tail (shorter than
   a window), its checksum, and its rank among the tails of its length bin in the same task.
2. The histogram of tails by bin (at most ``bins(window)`` rows) goes to the driver, which enumerates
   shallow combinations of bins that nearly fill a window, solves for their repeat counts by
   non-negative least squares, and rounds them down to what the histogram holds.
3. Ranks, made global by a running sum of the small (task, bin) counts, send each tail to its window.
4. Tails that no combination took are packed greedily: laid end to end and cut at window edges, the
   last, partial window at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artisieve.llm.common import slices, staged, word_bytes, word_hashes


# The parts of a tokenizer file by which words can be encoded alone, each pre-token by the model.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


_own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write these bytes as the letters of their own numbers, all others, in order, as 256 and on.
BYTE_LETTERS = dict(zip([*_own, *(b for b in range(256) if b not in _own)], [*_own, *range(256, 512 - len(_own))], strict=True))


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, splits and joins as ``WordIds`` does, and has special tokens in <> only."""
    steps = lambda part, key: (spec.get(part) or {}).get(key)
    model = spec["model"]
    return (
        steps("normalizer", "normalizers") == NORMALIZER
        and steps("pre_tokenizer", "pretokenizers") == PRE_TOKENIZER
        and all(t["content"].startswith("<") and t["content"].endswith(">") and " " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        and (model["type"], model.get("dropout"), model.get("ignore_merges")) == ("BPE", None, False)
    )


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes.

    Where the tokenizer file splits texts at white space and words by a known pattern, words are encoded once each:
    plain Latin-1 words are cut by the pattern and their pre-tokens go to the library's model, other words to the library. With any other tokenizer file whole texts go to the library.
    """

    def __init__(self, tokenizer_path: str, bound: int = 300_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        with open(tokenizer_path, encoding="utf-8") as f:
            self.by_word = splits_words(json.load(f))
        self.pattern = regex.compile(SPLIT)
        self.plain = regex.compile(r"[\x21-\x3b\x3d-\x7e\xa1-\xff]+")  # no <, with which special tokens begin
        # Words by hash, in two generations: those that are used again outlive the others.
        self.bound, self.words, self.before = bound, {}, {}
        self.parts: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}
        if self.by_word:
            self.marks = {bytes([c]): self._part(bytes([c])) for c in b".,;:!?)]}\""}

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: bytes) -> bytes:
        if (found := self.parts.get(part)) is None:
            text = part.decode("ascii") if part.isascii() else part.decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self.model.tokenize(text)]
            found = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._part(word.lower())
        if (mark := self.marks.get(word[-1:])) and word[:-1].isalpha():
            return self._part(word[:-1].lower()) + mark
        text = word.decode("utf-8")
        if not self.plain.fullmatch(text):
            return self._ids(text)
        return b"".join([self._part(part.encode("utf-8")) for part in self.pattern.findall(text.lower())])

    def _known(self, names: list[int], spelt: Callable[[int], bytes]) -> list[bytes]:
        """The ids of words by hash, those that are new from their spelling."""
        if len(self.words) >= self.bound:
            self.before, self.words = self.words, {}
        if len(self.parts) >= 2 * self.bound:
            self.parts.clear()
        ids, before = list(map(self.words.get, names)), self.before
        for i, found in enumerate(ids):
            if found is None:
                name = names[i]
                if (found := before.get(name)) is None:
                    found = self._word(spelt(i))
                ids[i] = self.words[name] = found
        return ids

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text, and ``end``; a null text is empty."""
        stop = struct.pack("<I", end)
        raw, bounds, inside, first = word_bytes(texts)
        whole = raw.tobytes()
        if not self.by_word or b"<|" in whole:
            return [np.frombuffer((self._ids(t) if t else b"") + stop, "<u4") for t in texts.to_pylist()]
        hashes, ends = word_hashes(texts)
        names, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        stops = np.flatnonzero(last) + 1
        starts, stops = starts[at].tolist(), stops[at].tolist()
        ids = self._known(names.tolist(), lambda i: whole[starts[i] : stops[i]])
        ids.append(stop)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = np.insert(which, ends[1:], len(names))
        count = size[which]
        place = np.cumsum(count)
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat((np.cumsum(size) - size)[which] - place + count, count) + np.arange(place[-1] if len(place) else 0)]
        return np.split(out, place[ends[1:] + np.arange(len(texts))][:-1])


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def bin_edges(window: int, exact: int = 128) -> np.ndarray:
    """Upper edges of the length bins: every length up to ``exact``, then steps of 1/``exact``."""
    edges = [1]
    while edges[-1] < window - 1:
        edges.append(min(window - 1, edges[-1] + max(1, edges[-1] // exact)))
    return np.array(edges)


def combinations(edges: np.ndarray, window: int) -> list[dict[int, int]]:
    """Shallow combinations (at most three different bins) whose upper edges nearly fill the window."""
    found: dict[tuple, dict[int, int]] = {}

    def complete(parts: dict[int, int], repeats: tuple[int, ...]) -> None:
        """Fills what is left with repeats of the one bin that leaves least over."""
        left = window - sum(int(edges[b]) * m for b, m in parts.items())
        for m in repeats:
            if left // m < 1:
                break
            b = int(np.searchsorted(edges, left // m, side="right")) - 1
            whole = dict(parts)
            whole[b] = whole.get(b, 0) + m
            if window - sum(int(edges[x]) * n for x, n in whole.items()) <= window // 64:
                found.setdefault(tuple(sorted(whole.items())), whole)

    step = max(1, len(edges) // 12)
    for a in range(len(edges)):
        most = int(window // edges[a])
        for m in sorted({1, 2, 3, max(1, most // 4), max(1, most // 2), most}):
            if m > most:
                continue
            complete({a: m}, (1, 2, 4, 16, 64))
            if m == 1:
                for b in range(a % step, len(edges), step):
                    if b != a and edges[a] * m + edges[b] < window:
                        complete({a: m, b: 1}, (1, 3))
    return list(found.values())


def nnls_counts(combos: list[dict[int, int]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Whole repeat counts x >= 0 that least-squares fit ``sum x_j combo_j`` to the histogram, never above it.

    Multiplicative updates keep x non-negative; counts are then rounded down against what is left.
    """
    rows = np.concatenate([np.full(len(c), j) for j, c in enumerate(combos)])
    cols = np.concatenate([np.fromiter(c, np.int64) for c in combos])
    mult = np.concatenate([np.fromiter(c.values(), np.float64) for c in combos])
    n, k = len(histogram), len(combos)
    target = np.bincount(rows, mult * histogram[cols], k)
    x = target / np.maximum(np.bincount(rows, mult * mult, k), 1) / max(k / n, 1)
    for _ in range(rounds):
        fit = np.bincount(cols, mult * x[rows], n)
        x = x * target / np.maximum(np.bincount(rows, mult * fit[cols], k), 1e-12)
    left, out = histogram.astype(np.int64).copy(), np.zeros(k, np.int64)
    for limit in (x, np.full(k, np.inf)):  # what rounding leaves over is offered to the same combinations again
        for j in np.argsort(-x, kind="stable"):
            take = min(int(min(limit[j], 2**62)), min(left[b] // m for b, m in combos[j].items()))
            if take > 0:
                out[j] += take
                for b, m in combos[j].items():
                    left[b] -= take * m
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def tokenised(docs: DataFrame, tokenizer_path: str, window: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """One staged row for each document: its whole windows' checksums, and its tail with bin and rank in the task."""
    edges = bin_edges(window)
    names = ["doc_id", "part", "n_row", "doc_tokens", "full_from", "full_crc", "tail", "bin", "bin_rank", "tail_crc", "tail_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer_path), TaskContext.get().partitionId()
        ranks, n_row, n_full = np.zeros(len(edges), np.int64), 0, 0
        for whole in batches:
            for b in slices(whole):
                out: list[tuple] = []
                for ids in words.encode(b.column(1), end):
                    full = len(ids) // window
                    tail = ids[full * window :]
                    k = int(np.searchsorted(edges, len(tail))) if len(tail) else None
                    out.append((part, n_row, len(ids), n_full, [_crc(ids[i * window : (i + 1) * window]) for i in range(full)], len(tail), k, int(ranks[k]) if len(tail) else None, _crc(tail), tail.tobytes()))
                    n_row, n_full = n_row + 1, n_full + full
                    if len(tail):
                        ranks[k] += 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    kind = dict(docs.dtypes)[id_col]
    return staged(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, part int, n_row long, doc_tokens long, full_from long, full_crc array<long>, tail int, bin int, bin_rank long, tail_crc long, tail_ids binary"), "tokenised")


def _running(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over tasks, for each ``by``: a row for each task and bin at most."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("part")
    return df.withColumn(out, F.sum(value).over(w) - F.col(value)).drop(value)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the one token ``end``. Null ids and repeated rows are packed like others; an
    empty table gives no pieces; other columns are not read. Every token lies in exactly one piece.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = tokenised(docs, tokenizer_path, window, end, id_col, text_col)
    edges = bin_edges(window)
    per_bin = rows.where("bin IS NOT NULL").groupBy("part", "bin").agg(F.count("*").alias("n"))
    histogram = np.zeros(len(edges), np.int64)
    for r in per_bin.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most one row a bin
        histogram[r["bin"]] = r["n"]
    combos = combinations(edges, window)
    counts = nnls_counts(combos, histogram)

    # bin -> (first rank, first sequence, repeats in a sequence, order of the bin in it)
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequences = np.zeros(len(edges), np.int64), 0
    for combo, n in zip(combos, counts.tolist(), strict=True):
        if n:
            for order, (b, m) in enumerate(sorted(combo.items(), reverse=True)):
                plan.setdefault(b, []).append((int(used[b]), sequences, m, order))
                used[b] += n * m
            sequences += n

    piece = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    by_task = rows.groupBy("part").agg(F.sum(F.size("full_crc").cast("long")).alias("n"))
    full = rows.where(F.size("full_crc") > 0).select("doc_id", "part", "doc_tokens", "full_from", F.posexplode("full_crc").alias("k", "ids_crc32")).join(_running(by_task, [], "n", "task_from"), "part")
    n_full = by_task.agg(F.sum("n")).first()[0] or 0
    full = full.select("doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("task_from") + F.col("full_from") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    ranked = rows.where("bin IS NOT NULL").drop("full_from", "full_crc").join(_running(per_bin, ["bin"], "n", "bin_from"), ["part", "bin"]).withColumn("rank", F.col("bin_from") + F.col("bin_rank")).drop("bin_from", "bin_rank")
    taken = F.element_at(F.lit(used.tolist()).cast("array<long>"), F.col("bin") + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {b: np.array(v) for b, v in plan.items()}
        for b in batches:
            bins, ranks = b.column("bin").to_numpy(), b.column("rank").to_numpy()
            seq, slot = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
            for k in np.unique(bins):
                at, t = bins == k, table[k]
                row = t[np.searchsorted(t[:, 0], ranks[at], side="right") - 1]
                seq[at] = row[:, 1] + (ranks[at] - row[:, 0]) // row[:, 2]
                slot[at] = row[:, 3] * (window + 1) + (ranks[at] - row[:, 0]) % row[:, 2]
            start = b.column("doc_tokens").to_numpy() - b.column("tail").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(start), b.column("tail").cast(pa.int64()), b.column("tail_crc"), b.column("doc_tokens"), pa.array(n_full + seq), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    planned = ranked.where(F.col("rank") < taken).select("doc_id", "bin", "rank", "doc_tokens", "tail", "tail_crc").mapInArrow(place, piece + ", slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    planned = planned.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("slot")

    # Greedy rest: tails end to end in (task, row) order.
    rest = ranked.where(F.col("rank") >= taken).select("doc_id", "part", "n_row", "doc_tokens", F.col("tail").cast("long").alias("tail"), "tail_ids")
    rest_by_task = rest.groupBy("part").agg(F.sum("tail").alias("n"))
    total = rest_by_task.agg(F.sum("n")).first()[0] or 0
    within = Window.partitionBy("part").orderBy("n_row").rowsBetween(Window.unboundedPreceding, -1)
    laid = rest.withColumn("at", F.coalesce(F.sum("tail").over(within), F.lit(0).cast("long"))).join(_running(rest_by_task, [], "n", "task_from"), "part").withColumn("at", F.col("at") + F.col("task_from"))
    edge = total - total % window
    last = [edge]
    for p in range(int(window).bit_length() - 1, -1, -1):
        if (total - edge) >> p & 1:
            last.append(last[-1] + (1 << p))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array(last)
        for b in batches:
            out: list[tuple] = []
            for doc, n, tail, raw, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail", "tail_ids", "at")), strict=True):
                ids, i = np.frombuffer(raw, "<u4"), 0
                while i < tail:
                    p = at + i
                    if p < edge:
                        seq, lo, hi = p // window, p // window * window, (p // window + 1) * window
                    else:
                        j = int(np.searchsorted(ends, p, side="right"))
                        seq, lo, hi = edge // window + j - 1, int(ends[j - 1]), int(ends[j])
                    m = min(tail - i, hi - p)
                    out.append((doc, n - tail + i, m, _crc(ids[i : i + m]), n, n_full + sequences + seq, p - lo))
                    i += m
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [b.column("doc_id").type, *[pa.int64()] * 6], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    greedy = laid.select("doc_id", "doc_tokens", "tail", "tail_ids", "at").mapInArrow(cut, piece + ", offset long")
    return full.unionByName(planned).unionByName(greedy)
