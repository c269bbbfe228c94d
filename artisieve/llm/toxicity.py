"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if hashed term i occurs. The
model is fitted on a bounded sample of labelled rows (``sample_rows``, the least hashes of their ids),
its size is fixed by ``bits`` and ``factors``, and every text is scored whole in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.llm.common import slices, small_batches

TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


class TermIds(dict):
    """term -> hashed id, remembered for up to ``bound`` terms: the frequent ones are met again at once, for the others a dictionary costs
    each worker more memory than it saves time."""

    def __init__(self, bits: int, bound: int = 20_000):
        self.mask, self.bound = (1 << bits) - 1, bound

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        k = self[term] = zlib.crc32(term) & self.mask
        return k

    def of(self, text: str | None) -> np.ndarray:
        terms = set(TERM.findall(text.encode("utf-8", "surrogatepass").lower())) if text else ()
        return np.unique(np.fromiter(map(self.__getitem__, terms), np.int32, len(terms)))


@dataclass
class FactorizationMachine:
    """``slot[term id]`` is the row of w and v, -1 where the term tells nothing of the label."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        kept = [s[s >= 0] for s in (self.slot[r] for r in rows)]
        return _sigmoid(_raw(kept, self.bias, self.w, self.v)[0])


def _sigmoid(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _raw(rows: list[np.ndarray], bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    who = np.repeat(np.arange(len(rows)), n)
    idx = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    linear = np.bincount(who, w[idx], len(rows))
    sums = np.stack([np.bincount(who, v[idx, f], len(rows)) for f in range(v.shape[1])], 1)
    squares = np.bincount(who, (v[idx] ** 2).sum(1), len(rows))
    return bias + linear + 0.5 * ((sums**2).sum(1) - squares), who, idx, sums


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = 18, factors: int = 4, steps: int = 3000, rate: float = 0.15, decay: float = 1e-5, screen: float = 4.0, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the logistic loss, over the terms whose document counts differ by label beyond ``screen`` sigmas."""
    rng, size = np.random.default_rng(seed), 1 << bits
    n = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=size)
    hit = np.bincount(np.concatenate([*(r for r, y in zip(rows, labels, strict=True) if y), np.zeros(0, np.int32)]), minlength=size)
    rate1 = float(labels.mean()) if len(labels) else 0.0
    base = min(max(rate1, 1e-3), 1 - 1e-3)
    z = np.abs(hit - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9))
    active = np.flatnonzero((z > screen) & (n >= 5))
    slot = np.full(size, -1, np.int32)
    slot[active] = np.arange(len(active))
    bias, w, v = float(np.log(base / (1 - base))), np.zeros(len(active)), rng.normal(0, 0.01, (len(active), factors))
    kept = [s[s >= 0] for s in (slot[r] for r in rows)]
    gw, gv, gb = np.full(len(active), 1e-6), np.full((len(active), factors), 1e-6), 1e-6
    batches = -(-len(kept) // 512)
    for _ in range(-(-steps // batches) if len(active) else 0):
        order = rng.permutation(len(kept))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            y, who, idx, sums = _raw([kept[i] for i in part], bias, w, v)
            err = (_sigmoid(y) - labels[part]) / len(part)
            d = np.bincount(idx, err[who], len(w)) + decay * w
            dv = np.stack([np.bincount(idx, err[who] * (sums[who, f] - v[idx, f]), len(w)) for f in range(factors)], 1) + decay * v
            gw, gv, gb = gw + d**2, gv + dv**2, gb + err.sum() ** 2
            w, v, bias = w - rate * d / np.sqrt(gw), v - rate / 3 * dv / np.sqrt(gv), bias - rate * err.sum() / np.sqrt(gb)
    return FactorizationMachine(slot, float(bias), w, v)


def in_fold(id_col: str, folds: int, fold: int):
    """Whether crc32(id as text) mod ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, sample_rows: int = 20_000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Fits on at most ``sample_rows`` labelled rows outside the held-out fold.

    Null ids and labels teach nothing; of several labels of one id the largest holds, of several texts the one of the largest terms; with no labelled row
    the model scores every text alike, near 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    if held_out:
        known = known.where(~in_fold(id_col, *held_out))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    texts = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(chosen), id_col)  # at most sample_rows small rows

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(bits)
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([ids.of(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "label", "terms"])

    kind = dict(docs.dtypes)[id_col]
    each = texts.mapInArrow(terms, f"id {kind}, label int, terms binary").groupBy("id", "label").agg(F.max("terms").alias("terms"))  # at most sample_rows rows
    with small_batches(docs.sparkSession):
        got = each.toArrow().sort_by("id")
    rows = [np.frombuffer(x, np.int32) for x in got.column("terms").to_pylist()]
    return fit(rows, np.array(got.column("label").to_pylist(), np.float64), bits)


def score(docs: DataFrame, model: FactorizationMachine, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row; a null or empty text gets the model's bias alone; repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(bits)
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score([ids.of(t) for t in b.column(1).to_pylist()]))], [id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, bits: int = 18, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(bits)
        for whole in batches:
            for b in slices(whole):
                yield b.filter(pa.array(shared.value.score([ids.of(t) for t in b.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
