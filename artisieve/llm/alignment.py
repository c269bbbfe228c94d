"""Cross-tokenizer alignment by whitespace-token anchors.

Each text is tokenised whole by two vocabularies whose tokens spell the same bytes. A place where both streams
begin a token that is marked as following a blank is an anchor: there the ends before it are shared, which is verified on
byte offsets. Anchors cut a text into windows of token ids. A window's groups and links depend on its two tuples of
ids alone, so a worker keeps them by the tuples; the windows of some texts that it has not met are worked out together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artisieve.llm.common import MULTIPLIER, mix64, scratch, slices, staged
from artisieve.llm.token_counts import BLANK, CHUNK, ChunkCounter

SHIFT = 32


def byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ``encode(texts)`` gives the ids of each text, None where they do not spell blank + text; and the bytes of each id."""

    def __init__(self, spelled: list[bytes], encode: Callable[[list[str]], list[np.ndarray | None]]):
        self.spelled, self.encode = spelled, encode
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.marked = np.array([x[:1] == b" " for x in spelled])
        self.value = mix64(np.arange(1, len(spelled) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def verified(spelled: list[bytes], ids: list[int], text: str) -> np.ndarray | None:
    """The ids, None where they do not spell blank + text."""
    return np.array(ids, np.int64) if b"".join(map(spelled.__getitem__, ids)) == (" " + text).encode("utf-8", "surrogatepass") else None


class ChunkIds(ChunkCounter):
    """chunk (first blank dropped) -> ids, packed, for models in which no token crosses from a chunk into the next (proven as for
    counts). A chunk whose ids do not spell it is None, and so is each text that holds it."""

    def _prove(self) -> dict:
        self.spelled = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace(BLANK, " ").encode() for i in range(self.model.get_piece_size())]
        return {}

    def learn(self, new: list[str]) -> None:
        """Keeps the ids of these chunks, encoded in one call."""
        encoded = self.model.encode(["x " + c for c in new], num_threads=1)
        flat = list(chain.from_iterable(x[self.lead :] for x in encoded))
        ends = np.cumsum([len(x) - self.lead for x in encoded])
        spelled = list(map(self.spelled.__getitem__, flat))
        wanted = [(" " + c).encode("utf-8", "surrogatepass") for c in new]
        at = np.cumsum([0, *map(len, spelled)])[ends]  # where each chunk's bytes end
        raw, cut = np.array(flat, np.int64).tobytes(), (8 * ends).tolist()
        self.update(zip(new, (raw[s:e] for s, e in zip([0, *cut], cut, strict=False)), strict=True))
        if b"".join(spelled) != b"".join(wanted) or (at != np.cumsum([*map(len, wanted)])).any():
            for c, x, want in zip(new, encoded, wanted, strict=True):
                if b"".join(map(self.spelled.__getitem__, x[self.lead :])) != want:
                    self[c] = None

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text. Chunks not met before go to the library in one call."""
        if not self.splits or any(BLANK in t for t in texts):
            return [verified(self.spelled, ids, t) for ids, t in zip(self.model.encode(texts, num_threads=1), texts, strict=True)]
        cut = [[c[1:] for c in CHUNK.findall(" " + t)] if "  " in t or t[0] == " " or t[-1] == " " else t.split(" ") for t in texts]
        every = set(chain.from_iterable(cut))
        new = [c for c in every if c not in self]
        if len(self) + len(new) > self.bound:
            self.clear()
            new = list(every)
        if new:
            self.learn(new)
        odd = {c for c in every if self[c] is None}
        out = [None if odd and not odd.isdisjoint(c) else np.frombuffer(b"".join(map(self.__getitem__, c)), np.int64) for c in cut]
        for c in new:
            if len(c) > 64:  # long chunks seldom come again
                del self[c]
        return out


def byte_level(path: str) -> Side:
    """A byte-level vocabulary in a tokenizers file; strings of special tokens inside texts are plain text. Where the merges
    are ranked as their tokens are numbered, and the splitting rule is the usual one, ``tiktoken`` gives the library's ids,
    which always spell the text, at four times its speed (a test compares them on every character)."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = byte_of()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    spelled = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab(with_added_tokens=True).items():
        spelled[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    vocab = spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    split = spec.get("pre_tokenizer") or {}
    ranked = [vocab[a + b] for a, b in pairs] == list(range(256, 256 + len(pairs))) and sorted(vocab[c] for c in of) == list(range(256))
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    if ranked and usual:
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the splitting rule of byte-level files
        fast = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks={spelled[i]: i for i in range(256 + len(pairs))}, special_tokens={})
        return Side(spelled, lambda texts: [np.array(fast.encode_ordinary(" " + t), np.int64) for t in texts])
    encoded = lambda texts: library.encode_batch([" " + t for t in texts], add_special_tokens=False)
    return Side(spelled, lambda texts: [verified(spelled, e.ids, t) for e, t in zip(encoded(texts), texts, strict=True)])


def pieces(path: str) -> Side:
    """A piece model: the blank marker spells a blank, a byte piece its byte. Chunks between blanks are encoded once for each that
    a worker meets."""
    chunks = ChunkIds(path, 300_000)
    return Side(chunks.spelled, chunks.ids)


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the consecutive runs of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def picked(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs that begin ``at`` and have these sizes, one after the other."""
    return places(sizes) + np.repeat(at, sizes)


class Aligner:
    """Alignments of whole texts, with a memo of windows: (A's ids, B's ids), packed -> (number of groups, their text, links, packed)."""

    def __init__(self, a_path: str, b_path: str, bound: int = 300_000):
        self.a, self.b, self.bound = byte_level(a_path), pieces(b_path), bound
        self.memo: dict[tuple[bytes, bytes], tuple[int, str, bytes]] = {}
        self.last_a, self.last_b = (pa.array([f"{i}{mark}" for mark in marks for i in range(len(side.spelled))]) for side, marks in ((self.a, ",|"), (self.b, ",;")))

    def aligned(self, a: np.ndarray, b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray) -> Iterator[tuple[int, str, bytes]]:
        """The alignment of each of the windows that follow each other in ``a`` and ``b``, of so many ids each."""
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.union1d(end_a, end_b)
        # Between two neighbouring ends lie one token of A and one of B, and each overlapping pair is met just once.
        links = (a[np.searchsorted(end_a, ends)] << SHIFT | b[np.searchsorted(end_b, ends)]).tobytes()
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        # The text of all groups: A's ids, each with its mark, then B's, group by group.
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last = lambda group: np.append(np.diff(group) != 0, True)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shift = len(self.a.spelled) * 2
        token = np.concatenate([a + len(self.a.spelled) * last(group_a), shift + b + len(self.b.spelled) * last(group_b)])[order]
        spelled = pa.concat_arrays([self.last_a, self.last_b]).take(pa.array(token))
        text = spelled.buffers()[2].to_pybytes().decode("ascii")
        at = np.frombuffer(spelled.buffers()[1], np.int32)
        window_end = end_a[np.cumsum(many_a) - 1]
        text_end = at[np.cumsum(many_a + many_b)].tolist()
        link_end = (8 * np.searchsorted(ends, window_end, "right")).tolist()
        groups = np.diff(np.searchsorted(shared, window_end, "right"), prepend=0).tolist()
        for n, t0, t1, l0, l1 in zip(groups, [0, *text_end], text_end, [0, *link_end], link_end, strict=False):
            yield n, text[t0 : t1 - 1], links[l0:l1]

    def windows(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray) -> list[tuple[int, str, bytes]]:
        """The alignment of each of these windows; those not met before are worked out together."""
        raw_a, raw_b = (x[picked(at, many)].astype(np.uint32).tobytes() for x, at, many in ((a, at_a, many_a), (b, at_b, many_b)))
        cut_a, cut_b = (np.cumsum(4 * many).tolist() for many in (many_a, many_b))
        keys = [(raw_a[s:e], raw_b[t:f]) for s, e, t, f in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b, strict=False)]
        out = [self.memo.get(k) for k in keys]
        new = np.flatnonzero([x is None for x in out])
        if len(new):
            if len(self.memo) + len(new) > self.bound:
                self.memo.clear()
            some_a, some_b = many_a[new], many_b[new]
            for i, found in zip(new.tolist(), self.aligned(a[picked(at_a[new], some_a)], b[picked(at_b[new], some_b)], some_a, some_b), strict=True):
                out[i] = found
                if len(keys[i][0]) <= 256:  # long windows seldom come again
                    self.memo[keys[i]] = found
        return out

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both streams of ids of each text; empty where they do not spell blank + text."""
        none = np.zeros(0, np.int64)
        full = [i for i, t in enumerate(texts) if t]
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        some = [texts[i] for i in full]
        for i, a, b in zip(full, self.a.encode(some), self.b.encode(some), strict=True):
            if a is not None and b is not None:
                out_a[i], out_b[i] = a, b
        return out_a, out_b

    def align(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256 and, as lists, the distinct links of each text with their numbers."""
        by_a, by_b = self.ids(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (by_a, by_b))
        full = np.flatnonzero(n_a)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(len(texts), np.int64), "n_links": np.zeros(len(texts), np.int64), "groups_sha256": [""] * len(texts)}
        cuts, links, times = np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(full):
            a, b = np.concatenate(by_a), np.concatenate(by_b)
            # All texts' bytes are one stream of both sides, so offsets agree beyond the first text too.
            size_a, size_b = self.a.size[a], self.b.size[b]
            begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
            first_a = np.cumsum(n_a)[full] - n_a[full]
            open_a, open_b = self.a.marked[a], self.b.marked[b]
            open_a[first_a] = open_b[np.cumsum(n_b)[full] - n_b[full]] = True
            anchors = np.intersect1d(begin_a[open_a], begin_b[open_b], assume_unique=True)
            at_a, at_b = np.searchsorted(begin_a, anchors), np.searchsorted(begin_b, anchors)
            many_a, many_b = np.diff(np.append(at_a, len(a))), np.diff(np.append(at_b, len(b)))
            key = np.zeros(len(anchors), np.uint64)
            with np.errstate(over="ignore"):
                for side, ids, at, many in ((self.a, a, at_a, many_a), (self.b, b, at_b, many_b)):
                    powers = np.cumprod(np.append(np.uint64(1), np.full(int(many.max()), MULTIPLIER)))
                    key = mix64(key + np.add.reduceat(side.value[ids] * powers[places(many)], at) + many.astype(np.uint64))
            _, one, kind = np.unique(key, return_index=True, return_inverse=True)
            windows = self.windows(a, b, at_a[one], at_b[one], many_a[one], many_b[one])
            # Windows of each text, then its links: counted by text and link.
            edge = np.searchsorted(at_a, np.append(first_a, len(a)))
            groups, spelled, packed = zip(*windows, strict=True)
            wide = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
            out["n_groups"][full] = np.add.reduceat(np.array(groups, np.int64)[kind], edge[:-1])
            out["n_links"][full] = np.add.reduceat(wide[kind], edge[:-1])
            each = np.array(spelled, object)[kind].tolist()
            for t, s, e in zip(full.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                out["groups_sha256"][t] = hashlib.sha256(";".join(each[s:e]).encode()).hexdigest()
            codes, local = np.unique(np.frombuffer(b"".join(packed), np.int64), return_inverse=True)
            where = picked((np.cumsum(wide) - wide)[kind], wide[kind])
            text = np.repeat(full, out["n_links"][full])
            both, times = np.unique(text * len(codes) + local[where], return_counts=True)
            links, cuts = codes[both % len(codes)], np.searchsorted(both // len(codes), np.arange(len(texts) + 1))
        for name, flat in (("pairs", links), ("times", times)):
            out[name] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int64()))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def alignments(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row of ``docs`` with row, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times: the
    distinct links of its text (A's id above B's, ``SHIFT`` bits apart) and how often each occurs.

    No shuffle. A text that is null or empty, or that the two vocabularies do not spell alike, has zeros, no links and an
    empty digest. Repeated rows and null ids are rows of their own; other columns are not read. Both files must
    exist on every executor.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "row long", *(f"{c} long" for c in COUNTS), "groups_sha256 string", "pairs array<long>", "times array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(a_path, b_path)
        for whole in batches:
            for b in slices(whole, 1 << 20):
                got = one.align(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(got[c]) for c in COUNTS), pa.array(got["groups_sha256"], pa.string()), got["pairs"], got["times"]], [*keep, "row", *COUNTS, "groups_sha256", "pairs", "times"])

    return docs.select(*keep, F.monotonically_increasing_id().alias("row"), text_col).mapInArrow(run, schema)


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): how many rows hold each link, and whether no other link of its A id is held by more. A group of the
    window is one A id: it has at most as many links as B has ids."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    return counts.select("pair", "docs", (F.col("docs") == most).alias("best"))


def corpus_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = 1_000_000) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``; see ``alignments`` for
    awkward rows. ``count_sum`` adds the corpus-wide count of each link, ``n_best`` numbers the links whose count is
    the greatest of their A id. Counts are broadcast only where they have at most ``broadcast_pairs`` rows, else joined by link;
    the rows are the same. The result is staged.
    """
    with scratch(docs.sparkSession):
        rows = staged(alignments(docs, a_path, b_path, text_col, (id_col,)), "alignments")
        counts = staged(link_counts(rows), "link-counts")
        few = counts.count() <= broadcast_pairs
        links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
        met = links.join(F.broadcast(counts) if few else counts, "pair")
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
        return staged(rows.select(id_col, "row", *COUNTS, "groups_sha256").join(sums, "row", "left").select(id_col, *COUNTS, *zero, "groups_sha256"), "aligned", keep=True)
