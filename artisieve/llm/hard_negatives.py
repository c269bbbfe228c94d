"""Hard-negative mining by Strassen multiplication of integer tiles.

Rows are dealt into tiles of at most ``A_BLOCK`` anchors and some ``C_BLOCK`` candidates. In a tile, blocks of anchors
are multiplied with blocks of candidates as 64-bit integers by Strassen's recursion: odd sides are padded with zeros,
sums are exact (modulo 2^64, so that only a score beyond 64 bits itself would wrap). A first pass multiplies rows of equal
label and keeps a heap of an anchor's best positives; a second pass meets all other labels and keeps, for each anchor and
positive, a heap of the best scores inside the positive's window. Heaps of the tiles merge by order, so that no
group of rows is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artisieve.llm.common import scratch, staged, unused

A_BLOCK, C_BLOCK = 65_536, 262_144
SIDE = 512
LEAF = 32
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` over int64 with seven products of half the side where plain multiplication has eight."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ij,kj->ik", a, np.ascontiguousarray(b.T))
    if m & 1 or k & 1 or n & 1:
        return strassen(np.pad(a, ((0, m & 1), (0, k & 1))), np.pad(b, ((0, k & 1), (0, n & 1))), leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:] = p
    c22[:] = p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out


class Heaps:
    """For each of ``n`` groups the ``size`` greatest scores, ties to the smaller id; equal (score, id) count once."""

    def __init__(self, n: int, size: int):
        self.score, self.id = np.full((n, size), LEAST), np.zeros((n, size), np.int64)
        self.filled = np.zeros(n, np.int64)

    def worst(self) -> np.ndarray:
        """What a score must reach at least to enter each group."""
        return np.where(self.filled == self.score.shape[1], self.score[:, -1], LEAST)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        size = self.score.shape[1]
        touched = np.unique(group)
        at, place = np.nonzero(np.arange(size) < self.filled[touched][:, None])
        group = np.concatenate([touched[at], group])
        score = np.concatenate([self.score[touched[at], place], score])
        ids = np.concatenate([self.id[touched[at], place], ids])
        order = np.lexsort((ids, ~score, group))  # ~ turns the order round without overflow
        group, score, ids = group[order], score[order], ids[order]
        new = np.ones(len(group), bool)
        new[1:] = (np.diff(group) != 0) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        group, score, ids = group[new], score[new], ids[new]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        keep = rank < size
        group, rank = group[keep], rank[keep]
        self.score[group, rank], self.id[group, rank] = score[keep], ids[keep]
        self.filled[touched] = np.bincount(np.searchsorted(touched, group), minlength=len(touched))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, score) of all that is held."""
        group, place = np.nonzero(np.arange(self.score.shape[1]) < self.filled[:, None])
        return group, self.id[group, place], self.score[group, place]


def matrix(column: pa.ListArray) -> np.ndarray:
    """Integer vectors as rows, shorter ones padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    d = int(size.max()) if len(size) else 0
    if (size == d).all():
        return flat.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], c.shape[1])
    return strassen(a[:, :d], c[:, :d].T)


class Positives:
    """The best rows of an anchor's own label, without those of its own id."""

    block = 8 * SIDE
    schema = "anchor long, positive_id long, positive_score long"

    def __init__(self, anchors: pa.RecordBatch, size: int, share: int):
        self.key, self.id, self.label = (anchors.column(x).to_numpy() for x in ("anchor", "id", "label"))
        self.x, self.heaps = matrix(anchors.column("x")), Heaps(len(self.key), size)
        self.by_label = np.argsort(self.label, kind="stable")

    def add(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(label, kind="stable")
        ids, label, x = ids[order], label[order], x[order]
        own = self.label[self.by_label]
        for one in np.unique(label):
            c = slice(*(np.searchsorted(label, one, side) for side in ("left", "right")))
            group = self.by_label[slice(*(np.searchsorted(own, one, side) for side in ("left", "right")))]
            for s in range(0, len(group), SIDE):
                g = group[s : s + SIDE]
                got = products(self.x[g], x[c])
                i, j = np.nonzero((got >= self.heaps.worst()[g][:, None]) & (self.id[g][:, None] != ids[c]))
                self.heaps.offer(g[i], got[i, j], ids[c][j])

    def rows(self) -> pa.RecordBatch:
        group, ids, score = self.heaps.rows()
        return pa.RecordBatch.from_arrays([pa.array(self.key[group]), pa.array(ids), pa.array(score)], ["anchor", "positive_id", "positive_score"])


class Windows:
    """The best rows of other labels whose score lies between a share of a positive's score and that score."""

    block = 2 * SIDE
    schema = "anchor long, place int, negative_id long, negative_score long"

    def __init__(self, anchors: pa.RecordBatch, size: int, share: int):
        self.key, self.label = anchors.column("anchor").to_numpy(), anchors.column("label").to_numpy()
        scores = anchors.column("scores")
        self.many = np.diff(scores.offsets.to_numpy())
        self.x, self.high = matrix(anchors.column("x")), matrix(scores).copy()
        self.width = self.high.shape[1]
        # 100 n >= share * p, without a product that could overflow: p - floor((100 - share) p / 100) in whole and rest.
        whole, rest = np.divmod(self.high, 100)
        self.low = self.high - ((100 - share) * whole + (100 - share) * rest // 100)
        void = (np.arange(self.width) >= self.many[:, None]) | (self.low > self.high)
        self.low[void], self.high[void] = np.iinfo(np.int64).max, LEAST
        self.heaps = Heaps(self.high.size, size)

    def add(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        for s in range(0, len(self.key), SIDE):
            low, high = self.low[s : s + SIDE], self.high[s : s + SIDE]
            least = np.maximum(low, self.heaps.worst().reshape(-1, self.width)[s : s + SIDE])
            got = products(self.x[s : s + SIDE], x)
            i, j = np.nonzero((got >= least.min(axis=1)[:, None]) & (got <= high.max(axis=1)[:, None]) & (self.label[s : s + SIDE][:, None] != label))
            score = got[i, j]
            for p in range(self.width):
                ok = (score >= least[i, p]) & (score <= high[i, p])
                self.heaps.offer((s + i[ok]) * self.width + p, score[ok], ids[j[ok]])

    def rows(self) -> pa.RecordBatch:
        group, ids, score = self.heaps.rows()
        return pa.RecordBatch.from_arrays([pa.array(self.key[group // self.width]), pa.array((group % self.width).astype(np.int32)), pa.array(ids), pa.array(score)], ["anchor", "place", "negative_id", "negative_score"])


def swept(tiles: DataFrame, make: Callable, size: int, share: int) -> DataFrame:
    """Rows of ``make`` for each tile: its anchors (kind 0) come first, its candidates are read in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, state = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            t, kind = b.column("tile").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(t) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if t[s] != tile:
                    if state is not None:
                        yield state.rows()
                    tile, held, state = t[s], [], None
                part = b.slice(s, e - s)
                if kind[s] == 0:
                    held.append(part)
                elif held or state is not None:
                    if state is None:
                        state, held = make(pa.Table.from_batches(held).combine_chunks().to_batches()[0], size, share), []
                    ids, label, x = part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("x"))
                    for k in range(0, len(ids), make.block):
                        state.add(ids[k : k + make.block], label[k : k + make.block], x[k : k + make.block])
        if state is not None:
            yield state.rows()

    return tiles.mapInArrow(run, make.schema)


def hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, share: int = 80, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: tuple[int, int] | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of another label whose score is at most the
    positive's and at least ``share`` hundredths of it. Scores are inner products of ``floor(scale * component)``,
    higher first, ties to the smaller id.

    ``anchors`` is an SQL condition on ``rows`` that names the anchors. Rows with a null id, a null label, a null vector
    or a null or non-finite component take no part; a shorter vector counts as padded with zeros, scaled components
    beyond 64 bits are held at their bounds. Rows of the anchor's own id are no positives of it. Rows that agree in id and
    score count once; an id with several vectors is several rows and, as anchor, several anchors. Labels are integers.
    ``blocks`` bounds a tile's anchors and candidates.
    """
    a_block, c_block = blocks or (A_BLOCK, C_BLOCK)
    spark = rows.sparkSession
    chosen = unused(rows.columns, "chosen")
    with scratch(spark):
        bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        x = F.col(vector_col).cast("array<double>")
        good = rows.withColumn(chosen, F.coalesce(F.expr(anchors), F.lit(False))).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, bad))
        whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
        good = staged(good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("x"), F.col(chosen).alias("chosen"), F.monotonically_increasing_id().alias("place")), "negatives-rows")
        n = good.agg(F.count("*").alias("rows"), F.count_if("chosen").alias("anchors")).first()
        na = -(-n["anchors"] // a_block) or 1
        nc = max(-(-n["rows"] // c_block), min(2 * spark.sparkContext.defaultParallelism, -(-n["rows"] // 1024)), 1)
        parts = min(na * nc, 1 << 15)
        own = good.where("chosen").select(F.xxhash64("id", "label", "x").alias("anchor"), "id", "label", "x").distinct()

        def tiles(left: DataFrame, more: list[str]) -> DataFrame:
            """Anchors once for each block of candidates, candidates once for each block of anchors."""
            other = {c: F.lit(None).cast(left.schema[c].dataType) for c in more}
            each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            left = left.withColumns({"kind": F.lit(0), "ca": F.pmod("anchor", F.lit(na)), "cc": each(nc)})
            right = good.withColumns({"kind": F.lit(1), "ca": each(na), "cc": F.pmod("place", F.lit(nc)), "anchor": F.lit(None).cast("long"), **other})
            cols = [(F.col("cc").cast("long") * na + F.col("ca")).alias("tile"), "kind", "anchor", "id", "label", "x", *more]
            both = left.select(*cols).unionByName(right.select(*cols))
            return both.repartition(parts, "tile").sortWithinPartitions("tile", "kind")

        best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
        found = swept(tiles(own, []), Positives, positives, share).distinct().withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives)
        found = staged(found, "negatives-positives")
        lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("l")).select("anchor", F.col("l.positive_score").alias("scores"))
        met = swept(tiles(own.join(lists, "anchor"), ["scores"]), Windows, negatives, share).distinct()
        first = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
        met = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
        out = met.join(found, ["anchor", "place"]).join(own.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        return staged(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", keep=True)
