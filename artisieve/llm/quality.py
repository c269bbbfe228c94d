"""Quality by random Fourier features: ridge on summed normal equations, then isotonic calibration.

Each text becomes a fixed vector of statistics; random cosines of it approximate a Gaussian kernel.
Every task sums its own normal equations over its labelled rows, the sums are added in a tree, and the
ridge system (of fixed size) is solved on the driver. Scores from two folds, each by the other fold's
model, are calibrated by isotonic regression over a fixed number of score bins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.llm.common import slices, staged
from artisieve.llm.toxicity import in_fold

LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256))
UPPER, DIGITS, SYMBOLS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*|<>{}[]\\/~^_=+@", b".,;:!?"
MARK = re.compile(rb"[^\w\s\x80-\xff](?=\s|$)")
N_STATS = 19


def statistics(text: str | None) -> list[float]:
    """Fixed document statistics; all zero for a null or empty text."""
    if not text:
        return [0.0] * N_STATS
    raw = text.encode("utf-8", "surrogatepass")
    words, lines, n = raw.split(), raw.split(b"\n"), len(raw)
    k = max(len(words), 1)
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    return [
        np.log1p(n), np.log1p(len(words)), float(size.mean()), float(size.std()), float((size <= 2).mean()), float((size >= 12).mean()),
        np.log(k / max(len(set(words)), 1)), max(Counter(words).values(), default=0) / k, 1 - len(set(zip(words, words[1:], strict=False))) / k,
        share(LETTERS), share(UPPER), share(DIGITS), share(SYMBOLS), share(STOPS), share(bytes(range(128, 256))),
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(MARK.findall(raw)) / k,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    std: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        return np.hstack([np.ones((len(x), 1)), x, np.sqrt(2 / len(self.phase)) * np.cos(x @ self.omega + self.phase)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.beta, self.knots, self.values)


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], [id_col, "stats"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by score: knots and non-decreasing shares of label 1."""
    blocks: list[list[float]] = []
    for at, n, y in zip(x.tolist(), total.tolist(), ones.tolist(), strict=True):
        blocks.append([at * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])


def _tree_sum(parts: DataFrame, n_parts: int, fan: int = 32) -> np.ndarray | None:
    """Adds float64 blobs over tasks, ``fan`` at a time, so that no group and no result grows with the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["blob"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // fan], "blob": [total.tobytes()]})

    while n_parts > fan:
        parts = parts.groupBy(F.floor(F.col("part") / fan).alias("to")).applyInPandas(add, "part long, blob binary")
        n_parts = -(-n_parts // fan)
    blobs = [np.frombuffer(r["blob"]) for r in parts.orderBy("part").collect()]  # at most ``fan`` rows
    return sum(blobs) if blobs else None


def train(stats: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, features: int = 160, ridge: float = 1.0, seed: int = 11, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fits on every labelled row outside the held-out fold. Null ids and labels teach nothing; of several labels of one id the least holds."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("double").alias("y"))
    if held_out:
        known = known.where(~in_fold(id_col, *held_out))
    rows = staged(stats.join(known, id_col).select("stats", "y", (F.pmod(F.xxhash64(id_col), F.lit(2))).cast("int").alias("fold")), "quality-train")
    moments = rows.agg(*[f(F.element_at("stats", i + 1)).alias(f"{k}{i}") for i in range(N_STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATS)])
    std = np.array([max(moments[f"s{i}"] or 0.0, 1e-3) for i in range(N_STATS)])
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, std, rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(0), np.zeros(1), np.full(1, 0.5))
    d = 1 + N_STATS + features

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d + 1))
        for b in batches:
            if b.num_rows:
                z, y, fold = model.features(np.array(b.column(0).to_pylist())), b.column(1).to_numpy(), b.column(2).to_numpy()
                for k in (0, 1):
                    at = fold == k
                    total[k] += z[at].T @ np.hstack([z[at], y[at, None]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "blob"])

    total = _tree_sum(rows.mapInArrow(sums, "part long, blob binary"), rows.rdd.getNumPartitions())
    if total is None or not total.any():
        model.beta = np.zeros(d)
        return model
    folds = total.reshape(2, d, d + 1)
    penalty = ridge * np.diag(np.r_[1e-6, np.ones(d - 1)])
    solve = lambda a: np.linalg.solve(a[:, :d] + penalty, a[:, d])
    cross = [solve(folds[1]) if folds[1].any() else solve(folds[0]), solve(folds[0]) if folds[0].any() else solve(folds[1])]
    model.beta = solve(folds.sum(0))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, fold = model.features(np.array(b.column(0).to_pylist())), b.column(2).to_numpy()
                raw = np.where(fold == 0, z @ cross[0], z @ cross[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * 256), -512, 767).astype(np.int64)), b.column(1)], ["bin", "y"])

    got = rows.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()  # at most 1280 rows
    table = np.array([[(r["bin"] + 0.5) / 256, r["n"], r["ones"]] for r in got])
    model.knots, model.values = isotonic(table[:, 0], table[:, 1], table[:, 2])
    return model


def score(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for each row of statistics; empty texts have statistics too."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(np.array(b.column(1).to_pylist())))], [id_col, "score"])

    kind = dict(stats.dtypes)[id_col]
    return stats.select(id_col, "stats").mapInArrow(run, f"`{id_col}` {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of ``docs``: statistics once, then the fit, then scores. Null texts count as empty."""
    stats = staged(document_statistics(docs, id_col, text_col), "quality-stats")
    return score(stats, train(stats, labels, held_out, id_col=id_col), id_col)
