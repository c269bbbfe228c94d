"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash of a unit vector is the signed axis nearest to it after a pseudo-rotation: three rounds of
random signs and a fast Hadamard transform. A key is one axis, or in a large corpus (``BUCKET`` candidates to a key) two of two
rotations. A query probes, in each table, the ``probes`` keys of greatest summed coordinates, their square with keys of
two axes and in half as many tables more, so that recall holds; candidates met there are scored exactly. A query that meets
fewer than it asks for is scored against all rows, in blocks.

Greatest inner product over vectors of unequal norms is reduced to angles by one more coordinate that brings
every candidate to the greatest norm (a query gets 0 there). Equal vectors are one candidate, with the least
ids that can matter, so that large groups of copies cost one row. A bucket is worked off in blocks of bounded
candidates and queries, whose grid comes from the bucket counts; each task merges what its blocks found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artisieve.llm.common import staged

C_BLOCK, Q_BLOCK = 16_384, 4_096
BUCKET = 4_096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, normalised; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    d = 1 << max(int(x.shape[1] - 1).bit_length(), 0)
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` nearest signed axes of each row, nearest first, with their coordinates: axis i is i, its negative d + i."""
    both = np.concatenate([x, -x], axis=1)
    probes = min(probes, both.shape[1])
    part = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, part, 1), axis=1, kind="stable")
    part = np.take_along_axis(part, order, 1)
    return part, np.take_along_axis(both, part, 1)


def keys(x: np.ndarray, table: int, seed: int, rotations: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest keys of each row, nearest first: one axis for each of the table's rotations. Keys of several axes are
    taken from the nearest axes of each, twice as many as a square of ``probes`` has on a side."""
    if len(x) > 1024:
        return np.concatenate([keys(x[s : s + 1024], table, seed, rotations, probes) for s in range(0, len(x), 1024)])
    side = probes if rotations == 1 else 2 * math.isqrt(probes)
    key, near = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for r in range(rotations):
        axis, near_r = axes(rotate(x, table + (r << 16), seed), side)
        sums = (near[:, :, None] + near_r[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        rows = np.arange(len(x))[:, None]
        width = axis.shape[1]
        with np.errstate(over="ignore"):
            key = key[rows, best // width] * 1_000_003 + axis[rows, best % width]
        near = np.take_along_axis(sums, best, 1)
    return key


def usable(column: str):
    """Neither null nor zero nor holding null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0)


FOUND = "q long, v long, lead long, score double"


def merged_best(found: DataFrame, most: int, limit: int = 500_000) -> DataFrame:
    """``found(q, v, lead, score)`` with each q's ``most`` best of each task only, ties to the smaller lead, without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def best() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            q, v, lead, s = (b.column(i).to_numpy() for i in range(4))
            order = np.lexsort((v, lead, -s, q))
            q_, v_ = q[order], v[order]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(q_) != 0) | (np.diff(v_) != 0)  # a pair has one score
            order = order[new]
            first = np.flatnonzero(np.diff(q[order], prepend=q[order[0]] - 1))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            return b.take(pa.array(order[rank < most]))

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) > limit:
                held = [best()]
                if held[0].num_rows > limit // 2:
                    yield held.pop()
        if held:
            yield best()

    return found.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, tables: int = 8, probes: int = 20, seed: int = 3, rotations: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``top`` best found by inner product, without itself.

    ``queries(id)`` names rows of ``vectors``. Ties go to the smaller id. Null ids and unusable vectors take
    no part; only vectors of the query's dimension are compared. A query has ``top`` rows, or all candidates where
    there are fewer. An id with several vectors is several candidates and several queries; its best places are kept.
    ``rotations`` to a key, 1 or 2, follow from the number of vectors unless given; ``probes`` and ``tables`` are those of one.
    """
    kind = dict(vectors.dtypes)[id_col]
    plain = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0))  # no negative zero
    good = vectors.select(F.col(id_col).alias("id"), plain.alias("x")).where(F.col("id").isNotNull() & usable("x")).withColumn("g", F.xxhash64("x"))
    # Members of a group of equal vectors: its least top + 1 ids are all that any answer can name.
    least_ids = lambda ids: F.slice(F.array_sort(ids), 1, top + 1)
    lead = F.col("ids")[0].cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(0).cast("long")  # decides ties between groups
    salted = good.distinct().groupBy("g", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.any_value("x").alias("x"), least_ids(F.collect_set("id")).alias("ids"))
    groups = staged(salted.groupBy("g").agg(F.any_value("x").alias("x"), least_ids(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("lead", lead), "ann-groups")
    asked = staged(good.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").select("id", "g").distinct(), "ann-queries")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b))
    spread = groups.agg(F.min(norm).alias("lo"), F.max(norm).alias("hi"), F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    lo, hi, d_max = spread["lo"] or 0.0, spread["hi"] or 0.0, spread["d"] or 1
    level = hi - lo <= 1e-3 * hi
    rotations = rotations or min(2, max(1, round(np.log(max(spread["n"] / BUCKET, 1)) / np.log(2 * d_max + 2))))
    probes, tables = probes**rotations, tables * (rotations + 1) // 2

    def hashed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, leads, xs = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1).to_pylist()
                sizes = np.fromiter(map(len, xs), np.int64, len(xs))
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    x = np.array([xs[i] for i in at])
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    if not level:
                        unit = np.hstack([unit, np.zeros((len(x), 1))]) if query else np.hstack([x / hi, np.sqrt(np.maximum(0, 1 - (x**2).sum(1) / hi**2))[:, None]])
                    raw = np.array([packed(r) for r in x], object)
                    for t in range(tables):
                        k = keys(unit, t, seed, rotations, probes if query else 1)
                        n = k.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k.size, t, np.int32)), pa.array(k.ravel() + (int(d) << 44)), pa.array(np.repeat(ids[at], n)), pa.array(np.repeat(leads[at], n)), pa.array(np.repeat(raw, n), pa.binary())], ["t", "bucket", "id", "lead", "raw"])

        return run

    def in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All vectors of one dimension in one bucket."""
        for b in batches:
            xs = [np.array(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xs), -1, np.int32)), pa.array([len(x) for x in xs], pa.int64()), b.column(0), b.column(2), pa.array([packed(x) for x in xs], pa.binary())], ["t", "bucket", "id", "lead", "raw"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        c_id, c_lead, c = left.column("id").to_numpy(), left.column("lead").to_numpy(), [unpacked(r) for r in left.column("raw").to_pylist()]
        q_id, q = right.column("id").to_numpy(), [unpacked(r) for r in right.column("raw").to_pylist()]
        out = []
        if c and q:
            order = np.argsort(c_lead, kind="stable")
            c_id, c_lead, c, q = c_id[order], c_lead[order], np.array(c)[order], np.array(q)
            for s in range(0, len(q), 256):
                got = np.einsum("ij,kj->ik", q[s : s + 256], c)
                k = min(top + 1, len(c))
                best = np.argsort(-got, axis=1, kind="stable")[:, :k]
                out.append(pa.table([pa.array(np.repeat(q_id[s : s + 256], k)), pa.array(c_id[best].ravel()), pa.array(c_lead[best].ravel()), pa.array(np.take_along_axis(got, best, 1).ravel())], ["q", "v", "lead", "score"]))
        return pa.concat_tables(out) if out else pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.float64())], ["q", "v", "lead", "score"])

    def compared(points: DataFrame, probing: DataFrame) -> DataFrame:
        """(q, v, lead, score): each query's best of each bucket that it shares with candidates."""
        count = lambda df, name: df.groupBy("t", "bucket").agg(F.count("*").alias(name))
        both = count(points, "c").join(count(probing, "q"), ["t", "bucket"])
        grid = staged(both.select("t", "bucket", F.ceil(F.col("c") / C_BLOCK).cast("int").alias("nc"), F.ceil(F.col("q") / Q_BLOCK).cast("int").alias("nq")), "ann-grid")

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            """Each row in its own block, once for each block of the other side."""
            df = df.join(grid, ["t", "bucket"])
            return df.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n{own}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))).select("t", "bucket", "c", "q", "id", "lead", "raw")

        by = ["t", "bucket", "c", "q"]
        found = dealt(points, "c", "q").groupBy(*by).cogroup(dealt(probing, "q", "c").groupBy(*by)).applyInArrow(score, FOUND)
        return merged_best(found, top + 1)

    def answers(found: DataFrame) -> DataFrame:
        """(q, best): each query group's best members (r, v, score), ties to the smaller id."""
        one = found.groupBy("q", "v").agg(F.max("score").alias("score"), F.min("lead").alias("lead"))
        near = one.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "lead"))).where(F.col("r") <= top + 1)
        members = near.join(groups.select(F.col("g").alias("v"), "ids"), "v").select("q", "score", F.explode("ids").alias("v"))
        ordered = members.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("r") <= top + 1)
        return ordered.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "v", "score"))).alias("best"))

    schema = "t int, bucket long, id long, lead long, raw binary"
    wanted = groups.join(asked.select("g").distinct(), "g", "left_semi")
    lists = staged(answers(compared(groups.select("g", "x", "lead").mapInArrow(hashed(False), schema), wanted.select("g", "x", "lead").mapInArrow(hashed(True), schema))), "ann-lists")
    short = wanted.join(lists.where(F.size("best") > top).select(F.col("q").alias("g")), "g", "left_anti").select("g", "x", "lead")
    rest = staged(short, "ann-short")
    if rest.limit(1).count():
        exact = answers(compared(groups.select("g", "x", "lead").mapInArrow(in_one, schema), rest.mapInArrow(in_one, schema)))
        lists = lists.join(rest.select(F.col("g").alias("q")), "q", "left_anti").unionByName(exact)
    best = asked.join(lists.withColumnRenamed("q", "g"), "g").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("best", lambda e: e["v"] != F.col("id")), 1, top)).alias("pos", "e"))
    rows = best.select("query_id", F.col("e.v").alias("vec_id"), F.col("e.score").alias("score"))
    several = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = several.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def packed(x: np.ndarray) -> bytes:
    """A vector's numbers in four bytes each where that is exact, after a mark of their width."""
    small = x.astype("<f4")
    return b"4" + small.tobytes() if (small == x).all() else b"8" + x.astype("<f8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<f{raw[:1].decode()}", offset=1).astype(np.float64)
